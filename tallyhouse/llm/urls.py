"""URL filter by the ratio of two character language models.

URLs that a rule decides are the examples: accepted and rejected ones train one
variable-order Markov model each over the characters of host and path. A character's
probability is interpolated (Witten-Bell) from the longest context that the model has seen
down to none. The score of a URL is its log-likelihood difference per character; the
limit is calibrated on a fifth of the examples that trained neither model. All of it is
built of joins, windows and grouped sums; the n-gram table grows with the URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import boxed, durable, field, unboxed

ORDER = 4  # characters of context
HELD_OUT = 5  # every fifth example calibrates
START = "\u0001"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        own = (host == rule.host) | host.endswith("." + rule.host)
        out = F.when(own & path.startswith(rule.path), F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of ``word``: the ORDER characters before it and itself."""
    padded = urls.withColumn("padded", F.concat(F.lit(START * ORDER), "word"))
    at = padded.filter("length(word) > 0").withColumn("at", F.explode(F.sequence(F.lit(1), F.length("word"))))
    return at.withColumn("gram", F.substring("padded", F.col("at"), F.lit(ORDER + 1))).drop("padded", "at")


def model(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log odds of an n-gram's last character from (gram, allow, block) counts."""
    levels = [counts]
    for _ in range(ORDER):
        shorter = F.substring("gram", F.lit(2), F.lit(ORDER + 1))
        levels.append(levels[-1].groupBy(shorter.alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    below, sides = None, ("allow", "block")
    for level in reversed(levels):
        n = F.length("gram")
        context = Window.partitionBy(F.substring("gram", F.lit(1), n - 1))
        known = level.withColumn("lower", F.substring("gram", F.lit(2), n))
        if below is None:
            everything = level.agg(F.count("*").alias("letters"), F.sum("allow").alias("allow_n"), F.sum("block").alias("block_n")).first()
            letters = (everything["letters"] or 0) + 1
            for s in sides:  # single characters: add-one over the alphabet and one unseen
                known = known.withColumn(f"{s}_p", (F.col(s) + 1) / F.lit((everything[f"{s}_n"] or 0) + letters))
        else:
            known = known.join(below, "lower")
            for s in sides:
                known = known.withColumns({f"{s}_n": F.sum(s).over(context), f"{s}_types": F.count(F.when(F.col(s) > 0, 1)).over(context)})
                seen = (F.col(s) + F.col(f"{s}_types") * F.col(f"{s}_p0")) / (F.col(f"{s}_n") + F.col(f"{s}_types"))
                known = known.withColumn(f"{s}_p", F.when(F.col(f"{s}_n") > 0, seen).otherwise(F.col(f"{s}_p0")))
        below = known.select(F.col("gram").alias("lower"), *[F.col(f"{s}_p").alias(f"{s}_p0") for s in sides])
    return known.select("gram", (F.log("allow_p") - F.log("block_p")).alias("ratio"))


def limit_of(scores: DataFrame) -> float:
    """The limit that minimises the sum of both error rates on (score, label); the middle one of the best, 0 without both kinds.

    Scores are counted in steps of 1/100 between -20 and 20, so the driver gets at most 4,001 rows.
    """
    step = F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) * 100).cast("int")
    n = lambda label: F.count(F.when(F.col("label") == label, 1))
    steps = sorted((r["step"], r["a"], r["b"]) for r in scores.groupBy(step.alias("step")).agg(n("allow").alias("a"), n("block").alias("b")).collect())
    allowed, blocked = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not allowed or not blocked:
        return 0.0
    cuts, below_a, below_b = [(1.0, steps[0][0] - 1)], 0, 0
    for (s, a, b), follows in zip(steps, [*[x[0] for x in steps[1:]], steps[-1][0] + 1]):
        below_a, below_b = below_a + a, below_b + b
        cuts.append((below_a / allowed + (blocked - below_b) / blocked, (s + follows) / 2))
    least = min(c[0] for c in cuts)
    best = sorted(x for e, x in cuts if e == least)
    return best[len(best) // 2] / 100


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Rows with ``host``, ``path``, ``rule``, ``verdict`` and ``score``.

    ``rules`` are few and compiled into the projection. The verdict is that of the longest
    rule that fits, else ``allow`` if the score reaches the limit. A null url, or one
    without ``://``, has empty host and path and fits no rule; with nothing to judge its
    score is null and its verdict ``allow``, as it is without examples of both kinds.
    Equal urls have equal results, and are judged once. Columns named like the new ones
    are replaced.
    """
    address = lambda c: {"host": host_of(c), "path": path_of(c)}
    rows = boxed(pages).withColumns(address(field(url).cast("string")))
    words = rows.select("host", "path").distinct().withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    words = words.withColumn("word", F.concat("host", "path")).withColumn("held", F.pmod(F.xxhash64("word"), F.lit(HELD_OUT)) == 0)
    words = durable(words)
    train = lambda label: F.count(F.when((F.col("rule.verdict") == label) & ~F.col("held"), 1)).alias(label)
    grams = _grams(words.select("host", "path", "word", "rule", "held"))
    table = durable(model(durable(grams.groupBy("gram").agg(train("allow"), train("block")))))
    spelt = _grams(words.select("host", "path", "word")).select("host", "path", "gram")
    scores = durable(spelt.join(table, "gram").groupBy("host", "path").agg(F.avg("ratio").alias("score")))
    examples = words.filter("held and rule is not null").join(scores, ["host", "path"])
    limit = limit_of(examples.select("score", F.col("rule.verdict").alias("label")))
    by_score = F.when(F.col("score").isNull() | (F.col("score") >= limit), "allow").otherwise("block")
    out = rows.join(scores, ["host", "path"], "left").withColumn("fits", rule_of(F.col("host"), F.col("path"), rules))
    return unboxed(
        out, pages.columns,
        {"host": F.col("host"), "path": F.col("path"), "rule": F.col("fits.name"), "verdict": F.coalesce("fits.verdict", by_score), "score": F.col("score")},
    )
