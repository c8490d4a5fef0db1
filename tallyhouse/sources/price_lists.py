"""Price lists the tests and queries use.

Fixed values: published list prices in USD per million tokens, the ordered
prefix list, defaults and cache multiplier of the standard catalog, and the
two-model tiered example.
"""

STANDARD = {
    "version": "2",
    "effective_date": "2026-07-01",
    "cache_read_multiplier": 0.5,
    "models": {
        "gpt-4o": {"input_per_m": 2.50, "output_per_m": 10.00},
        "gpt-4o-mini": {"input_per_m": 0.15, "output_per_m": 0.60},
        "o1": {"input_per_m": 15.00, "output_per_m": 60.00},
        "o3-mini": {"input_per_m": 1.10, "output_per_m": 4.40},
        "claude-opus-4": {"input_per_m": 15.00, "output_per_m": 75.00},
        "claude-sonnet-4": {"input_per_m": 3.00, "output_per_m": 15.00},
        "claude-haiku-4": {"input_per_m": 0.80, "output_per_m": 4.00},
        "gemini-1.5-pro": {"input_per_m": 3.50, "output_per_m": 10.50},
        "gemini-1.5-flash": {"input_per_m": 0.075, "output_per_m": 0.30},
        "text-embedding-3-small": {"embedding_per_m": 0.02},
        "text-embedding-3-large": {"embedding_per_m": 0.13},
        "deepseek-v4-flash": {"input_per_m": 0.14, "output_per_m": 0.28},
        "deepseek-v4-pro": {"input_per_m": 0.435, "output_per_m": 0.87},
        "deepseek-chat": {"input_per_m": 0.27, "output_per_m": 1.10},
        "deepseek-reasoner": {"input_per_m": 0.55, "output_per_m": 2.19},
        "qwen-max": {"input_per_m": 1.60, "output_per_m": 6.40},
        "qwen-plus": {"input_per_m": 0.40, "output_per_m": 1.20},
        "qwen-turbo": {"input_per_m": 0.10, "output_per_m": 0.30},
        "qwen-long": {"input_per_m": 0.50, "output_per_m": 2.00},
        "glm-4": {"input_per_m": 0.50, "output_per_m": 0.50},
        "glm-4-flash": {"input_per_m": 0.06, "output_per_m": 0.06},
        "glm-4-air": {"input_per_m": 0.10, "output_per_m": 0.10},
        "moonshot-v1-8k": {"input_per_m": 0.20, "output_per_m": 2.00},
        "moonshot-v1-32k": {"input_per_m": 1.00, "output_per_m": 3.00},
        "moonshot-v1-128k": {"input_per_m": 2.00, "output_per_m": 5.00},
        "doubao-pro-32k": {"input_per_m": 0.80, "output_per_m": 2.00},
        "doubao-lite-32k": {"input_per_m": 0.30, "output_per_m": 0.60},
        "baichuan4-turbo": {"input_per_m": 0.50, "output_per_m": 0.50},
        "abab6.5-chat": {"input_per_m": 0.30, "output_per_m": 1.00},
        "hunyuan-lite": {"input_per_m": 0.00, "output_per_m": 0.00},
        "hunyuan-pro": {"input_per_m": 0.40, "output_per_m": 1.20},
    },
    "defaults": {"input_per_m": 1.00, "output_per_m": 3.00, "embedding_per_m": 0.10},
    "prefix_models": [
        "gpt-4o-mini", "gpt-4o", "o3-mini", "o1",
        "claude-opus-4", "claude-sonnet-4", "claude-haiku-4",
        "gemini-1.5-pro", "gemini-1.5-flash",
        "text-embedding-3-large", "text-embedding-3-small",
        "moonshot-v1-128k", "moonshot-v1-32k", "moonshot-v1-8k",
        "deepseek-v4-pro", "deepseek-v4-flash", "deepseek-reasoner", "deepseek-chat",
        "qwen-max", "qwen-plus", "qwen-turbo", "qwen-long",
        "glm-4-flash", "glm-4-air", "glm-4",
        "doubao-pro-32k", "doubao-lite-32k",
        "baichuan4-turbo", "abab6.5-chat",
        "hunyuan-lite", "hunyuan-pro",
    ],
}

TIERED = {
    "version": "tiered-example-1",
    "effective_date": "2026-07-01",
    "cache_read_multiplier": 0.5,
    "volume_scope": "customer_model",
    "billing_period": "calendar_month",
    "models": {
        "gpt-4o-mini": {
            "pricing_mode": "volume",
            "input_per_m": 0.15,
            "output_per_m": 0.60,
            "tiers": [
                {"up_to_tokens_m": 10, "input_per_m": 0.15, "output_per_m": 0.60},
                {"up_to_tokens_m": 100, "input_per_m": 0.12, "output_per_m": 0.48},
                {"up_to_tokens_m": None, "input_per_m": 0.10, "output_per_m": 0.40},
            ],
        },
        "claude-sonnet-4": {
            "pricing_mode": "graduated",
            "input_per_m": 3.00,
            "output_per_m": 15.00,
            "tiers": [
                {"up_to_tokens_m": 1, "input_per_m": 2.00, "output_per_m": 4.00},
                {"up_to_tokens_m": None, "input_per_m": 1.00, "output_per_m": 2.00},
            ],
        },
    },
    "defaults": {"input_per_m": 1.00, "output_per_m": 3.00, "embedding_per_m": 0.10},
    "prefix_models": ["gpt-4o-mini", "claude-sonnet-4"],
}

# The store-then-query baseline prices exact model names only,
# in thousandths of a dollar per million tokens: (input, output).
BASELINE_PRICES = {
    "gpt-4o": (2500, 10000),
    "gpt-4o-mini": (150, 600),
    "o1": (15000, 60000),
    "o3-mini": (1100, 4400),
    "claude-opus-4": (15000, 75000),
    "claude-sonnet-4": (3000, 15000),
    "claude-haiku-4": (800, 4000),
    "gemini-1.5-pro": (3500, 10500),
    "gemini-1.5-flash": (75, 300),
}
BASELINE_DEFAULT = (1000, 3000)
BASELINE_REASONING = {"o1": 60000, "o3-mini": 4400}
BASELINE_REASONING_DEFAULT = 3000
BASELINE_CACHE_READ = {"gpt-4o": 1250, "gpt-4o-mini": 75, "claude-sonnet-4": 1500}
BASELINE_CACHE_READ_DEFAULT = 500
