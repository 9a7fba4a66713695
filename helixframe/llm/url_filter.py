"""URL filters: logistic regression on hashed character 3-grams of host and path, under fixed allow and block rules.

Scoring uses DataFrame functions only. The model is trained on the driver from the small table LABELLED, written out
below; its weights have a fixed number, so the array literal that carries them doesn't grow with the data.
Null URLs and URLs without :// have empty host and path and are judged by the method like any other.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
#: The rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Hosts and paths of the labelled table; 1 is to be blocked.
LABELLED = [
    *[(f"{p}{h}.{t}", path, 1) for h in ("casino-win", "free-bets", "cheap-pills", "ads-track", "win-casino", "pills-shop", "bets-free", "adserver", "poker-bonus", "xxx-cams")
      for p, t in (("", "example.com"), ("www.", "example.net"), ("m.", "test.io")) for path in ("/en/12", "/offer/77.html", "/")],
    *[(f"{p}{h}.{t}", path, 0) for h in ("theering", "nations", "library", "weather", "garden", "school", "thther", "recipes", "history", "tionhen", "museum", "journal", "")
      for p, t in (("", "example.com"), ("www.", "example.net"), ("blog.", "test.io")) for path in ("/en/12", "/article/77.html", "/")],
    ("", "", 0),
]


def grams(host: str, path: str) -> list[int]:
    s = f"^{host}|{path}$"
    return [zlib.crc32(s[i : i + 3].encode()) % BUCKETS for i in range(len(s) - 2)]


@lru_cache(maxsize=1)
def weights() -> tuple[float, ...]:
    """Stochastic gradient descent over LABELLED in its order; the last weight is the bias. Rounded, so that it prints exactly."""
    w = [0.0] * (BUCKETS + 1)
    rows = [(grams(h, p), y) for h, p, y in LABELLED]
    for epoch in range(40):
        rate = 0.5 / (1 + epoch / 10)
        for g, y in rows:
            error = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, w[BUCKETS] + sum(w[i] for i in g) / 8))))
            for i in g:
                w[i] += rate * (error / 8 - 1e-5 * w[i])
            w[BUCKETS] += rate * error / 8
    return tuple(round(x, 6) for x in w)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p)).otherwise(out)
    return out


def block_score(host: Column, path: Column) -> Column:
    """Probability that the method blocks. The weights are summed as whole millionths, so that order does not matter."""
    # one binary literal of fixed-width decimals: a lookup is a constant-time substr
    w = F.lit(bytearray("".join(f"{round(x * 1_000_000):10d}" for x in weights()[:BUCKETS]).encode()))
    weight = lambda g: F.substr(w, (F.crc32(F.encode(g, "utf-8")) % BUCKETS * 10 + 1).cast("int"), F.lit(10)).cast("string").cast("long")
    chars = F.split(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), "")
    chars = F.filter(chars, lambda c: c != "")
    gram = F.transform(F.arrays_zip(chars.alias("a"), F.slice(chars, F.lit(2), F.size(chars)).alias("b"), F.slice(chars, F.lit(3), F.size(chars)).alias("c")),
                       lambda z: F.concat(z["a"], z["b"], z["c"]))
    total = F.aggregate(gram, F.lit(0).cast("long"), lambda acc, g: acc + F.when(g.isNull(), F.lit(0).cast("long")).otherwise(weight(g)))
    return 1 / (1 + F.exp(-(F.lit(weights()[BUCKETS]) + total / 8_000_000)))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, score."""
    hosted = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = hosted.withColumn("rule", rule_of(F.col("host"), F.col("path"))).withColumn("score", block_score(F.col("host"), F.col("path")))
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for v, h, p in RULES:
        verdict = F.when(F.col("rule") == h + p, v).otherwise(verdict)
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
