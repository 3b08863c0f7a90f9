"""Quality rules whose cutoffs keep a promise on labelled documents.

Fixed base rules come first. Further rules reject texts whose measures lie beyond
cutoffs. Labelled documents that pass the base rules are parted by a digest of their id:

- a quarter shapes, per stratum, one path of rule sets from mild to strict. A step
  of the path has a cutoff for every rule that parts bad from good documents there; the
  cutoffs come from the good documents' own values, and later steps reject all that
  earlier ones do. The path ends where the share of rejected bad documents exceeds that of good ones most;
- the others, the holdout, walk the path. A step is taken if the exact binomial
  chance of so few rejected good documents, were the true share above ``risk``, is at most
  ``error / strata``, and the first step that fails ends the walk. Steps tested in a fixed
  order need no correction among themselves. The strata are corrected for, but for those whose holdout
  is so small that no outcome could pass: they take no step and are not tested.

So with a chance of at least 1 - ``error`` the rules reject at most ``risk`` of the good documents
of every stratum, as far as labelled documents are independent draws of it. With ``risk`` 0.02 and ``error`` 0.05
a single stratum needs 149 good documents in the holdout, none of them rejected, and each of four strata 217.

A value is compared by its class: its thousandths, of which the highest seven bits count.
There are under 4,000 classes, so the counts that cutoffs are read from are a small table
whatever the input, and hold integers only.

Defined results: a missing text has no words and fails the base rules. A missing
stratum is a stratum of its own, apart from an empty one. A document that is labelled more than once is good
if any of its labels says so. Repeated rows get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.numtext import Words, chunks, parts
from haulframe.llm.storage import stored

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WORDS = 5
MIN_WORDS = 10


@dataclass(frozen=True)
class Rule:
    """Rejects large (or, if ``below``, small) values of ``part / whole``."""

    name: str
    part: str
    whole: str
    below: bool = False

    def badness(self) -> Column:
        """Class of the value, larger where it is worse."""
        x = f"((1000 * {self.part}) div greatest({self.whole}, 1))"
        dropped = f"greatest(length(bin({x})) - {CLASS_BITS}, 0)"
        class_ = F.expr(f"cast({2 ** (CLASS_BITS - 1)} * {dropped} + shiftright({x}, {dropped}) as bigint)")
        return -class_ if self.below else class_


#: Highest bits of a value that its class keeps.
CLASS_BITS = 7

RULES = (
    Rule("symbols", "n_symbols", "n_words"),
    Rule("duplicate_lines", "n_dup_lines", "n_lines"),
    Rule("repeated_words", "n_repeat_words", "n_words"),
    Rule("long_words", "word_chars", "n_words"),
    Rule("short_words", "word_chars", "n_words", below=True),
)

#: The path. First steps lie this many classes beyond the worst good document, ...
MARGINS = (64, 32, 16, 8, 0)
#: ... later ones let every rule reject this share of ``risk`` of the good documents that shape the path.
PARTS_OF_RISK = (0.0625, 0.125, 0.25, 0.5, 1.0)
STEPS = len(MARGINS) + len(PARTS_OF_RISK)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``MEASURES`` of UTF-8 texts."""
    out = {name: np.zeros(len(texts), dtype=np.int64) for name in MEASURES}
    for first, some in chunks(texts):
        w = Words(some)
        here = slice(first, first + len(some))
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in some]
        out["n_words"][here] = w.per_doc(slice(None))
        out["word_chars"][here] = w.count_bytes(w.inside & ((w.buf & 0xC0) != 0x80))
        out["n_symbols"][here] = w.count_bytes(SYMBOLS[w.buf])
        out["n_lines"][here] = [len(x) for x in lines]
        out["n_dup_lines"][here] = [len(x) - len(set(x)) for x in lines]
        out["n_repeat_words"][here] = w.per_doc(w.repeated(REPEAT_WORDS))
    return out


def measures(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and the measures of every whole text."""
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def measured(batches):
        for batch in parts(batches, "_text"):
            found = measure_texts(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), *(pa.array(found[m]) for m in MEASURES)], [*keep, *MEASURES]
            )

    return rows.mapInArrow(measured, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{m} bigint" for m in MEASURES)]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def chance_of_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X of n trials, exactly summed."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log((n - i + 1) / i) + math.log(p / (1 - p))))) + n * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def labelled_classes(measured: DataFrame, labels: DataFrame, rules: Sequence[Rule], doc_id: str, stratum: str, quality: str) -> DataFrame:
    """Labelled documents that pass the base rules: stratum, good, holdout, and a class per rule."""
    marks = labels.groupBy(F.col(doc_id).alias("_doc")).agg((F.max(quality) == 1).alias("good")).where("good is not null")
    return measured.where(~base_failed()).join(marks, F.col(doc_id) == F.col("_doc")).select(
        F.col(stratum).alias("stratum"), "good",
        (F.substring(F.md5(F.col(doc_id).cast("string").cast("binary")), 1, 1) >= "4").alias("holdout"),
        *(r.badness().alias(r.name) for r in rules),
    )


def rule_paths(fitting: DataFrame, rules: Sequence[Rule], risk: float) -> DataFrame:
    """Per stratum with good documents: ``stratum`` and, per rule, its cutoffs by step (NULL: the rule is not used).

    A rule is used if its strictest cutoff rejects a larger share of the bad documents than of the good ones.
    """
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("class")) for r in rules)))
    counts = fitting.select("stratum", "good", each.alias("v")).groupBy("stratum", "v.rule", "v.class").agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad")
    )
    # one row per class, which are few: the window is bounded whatever the input
    of_rule = Window.partitionBy("stratum", "rule")
    worse = of_rule.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({
        "above": F.coalesce(F.sum("n_good").over(worse), F.lit(0)), "bad_above": F.coalesce(F.sum("n_bad").over(worse), F.lit(0)),
        "all_good": F.sum("n_good").over(of_rule), "all_bad": F.sum("n_bad").over(of_rule),
    })
    held = F.col("n_good") > 0
    allowed = lambda part: held & (F.col("above") <= F.lit(part * risk) * F.col("all_good"))
    strictest = allowed(PARTS_OF_RISK[-1])
    cuts = counts.groupBy("stratum", "rule").agg(
        F.array(
            *(F.max(F.when(held, F.col("class"))) + m for m in MARGINS),
            *(F.min(F.when(allowed(part), F.col("class"))) for part in PARTS_OF_RISK),
        ).alias("cuts"),
        F.min_by(F.struct("above", "bad_above", "all_good", "all_bad"), F.when(strictest, F.col("class"))).alias("at"),
    ).where("at.bad_above * at.all_good > at.above * at.all_bad")
    return cuts.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r.name, F.col("cuts"))).alias(f"{r.name}_cuts") for r in rules))


def first_rejecting_step(rules: Sequence[Rule]) -> Column:
    """Index of the mildest step that rejects a row of classes and cutoffs; ``STEPS`` if none does."""

    def spared(r: Rule) -> Column:
        steps = F.size(F.filter(f"{r.name}_cuts", lambda cut: cut >= F.col(r.name)))
        return F.when(F.col(f"{r.name}_cuts").isNull(), F.lit(STEPS)).otherwise(steps)

    return F.least(*map(spared, rules))


def _same_stratum(name: str) -> Column:
    return F.col("stratum").eqNullSafe(F.col(name))


def fit_paths(measured: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, risk: float = 0.02, error: float = 0.05,
              doc_id: str = "doc_id", stratum: str = "stratum", quality: str = "quality") -> DataFrame:
    """One row per stratum where rules apply: ``_stratum``, the cutoffs of ``rule_paths``, and
    ``taken``, the number of steps that the holdout allows.

    Counts are taken in Spark over all labelled documents.
    """
    seen = stored(labelled_classes(measured, labels, rules, doc_id, stratum, quality), "labelled-classes")
    paths = stored(rule_paths(seen.where(~F.col("holdout")), rules, risk), "rule-paths").withColumnRenamed("stratum", "_stratum")
    steps = seen.join(paths, _same_stratum("_stratum"), "left").withColumn("_step", first_rejecting_step(rules))
    count = lambda which: F.count_if(which & F.col("good"))
    shapes, bad = ~F.col("holdout"), ~F.col("holdout") & ~F.col("good")
    by_step = lambda which: F.array(*(F.count_if(which & (F.col("_step") <= j)) for j in range(STEPS)))
    tests = stored(
        steps.groupBy("stratum").agg(
            count(F.col("holdout")).alias("n"), by_step(F.col("holdout") & F.col("good")).alias("rejected"),
            count(shapes).alias("shape_good"), by_step(shapes & F.col("good")).alias("shape_rejected"),
            F.count_if(bad).alias("shape_bad"), by_step(bad).alias("shape_caught"),
        ).where(F.col("n") * F.lit(math.log1p(-risk)) <= F.lit(math.log(error))),
        "holdout-counts",
    )
    level = error / max(1, tests.count())
    kind = measured.schema[stratum].dataType.simpleString()

    def walk(frames):
        for pdf in frames:
            taken = []
            for row in pdf.itertuples():
                fine = [chance_of_at_most(int(k), row.n, risk) <= level for k in row.rejected]
                gains = [int(c) * row.shape_good - int(g) * row.shape_bad for c, g in zip(row.shape_caught, row.shape_rejected)]
                end = gains.index(max(gains)) + 1 if max(gains) > 0 else 0
                taken.append(min((fine + [False]).index(False), end))
            yield pd.DataFrame({"stratum": pdf["stratum"], "taken": pd.Series(taken, dtype="int32", index=pdf.index)})

    walked = tests.mapInPandas(walk, f"stratum {kind}, taken int").where("taken > 0")
    return paths.join(walked, _same_stratum("_stratum")).drop("stratum")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang",
          rules: Sequence[Rule] = RULES, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Per row: doc_id, the measures, ``base_failed``, ``kept``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    measured = stored(measures(rows, "text", ("doc_id", "stratum")), "measures")
    # one row per stratum, stored: its size is known when the join is planned
    paths = stored(fit_paths(measured, labels.select("doc_id", "quality"), rules, risk, error), "paths")
    judged = measured.withColumns({r.name: r.badness() for r in rules}).join(paths, _same_stratum("_stratum"), "left")
    rejected = F.coalesce(first_rejecting_step(rules) < F.col("taken"), F.lit(False))
    return judged.select(
        "doc_id", *MEASURES, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept")
    )
