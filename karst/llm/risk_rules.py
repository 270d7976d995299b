"""Quality rules with risk-controlled thresholds.

Base rules are fixed: fewer than ``LEAST_WORDS`` words, or more than half of the words in
repeated 3-word windows, fail a document. Further measures get their cutoffs from
labelled documents, apart for each stratum (a class of text length). One half of these, by a
hash of their ids, proposes: for each of ``LEVELS``, each measure's strictest cutoff of its grid
that rejects no larger share of the good ones, or the mildest that rejects as many bad ones.
The levels are nested, from mild to strict. The other half, the holdout, tests them in that
order: a level holds if the exact binomial (Clopper-Pearson) upper bound of the share of good
documents that any of its cutoffs rejects stays within ``ALPHA``. Testing stops at the first that
doesn't (fixed-sequence testing, so the levels cost no confidence); of those that hold, the mildest
that rejects as many bad documents is taken. The confidence is Bonferroni-corrected for the number
of strata. So with probability of at least ``1 - DELTA`` no stratum loses more than ALPHA of its
good documents to these rules. Where nothing holds (about 80 good documents in the holdout are the
least) there are no cutoffs; ``level`` says so for each row, as null.

The counts are over all labelled documents; only counts by step and level, of fixed size, reach
the driver.

Edge cases: null and empty texts have no words and fail; null or unknown labels aren't
counted; a stratum without enough labels gets no cutoffs; equal rows get equal verdicts;
a null doc_id has no label; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, labelled

LEAST_WORDS = 50
ALPHA, DELTA = 0.05, 0.05
#: Upper bounds of the strata, in words.
STRATA = (200, 1000)
#: Shares of good documents that a measure's cutoff may reject in the proposing half, from mild to strict.
LEVELS = (0.0, 0.002, 0.004, 0.006, 0.01, 0.015, 0.02, 0.03)
#: Grid of cutoffs, mildest first. A measure above ("over") or below ("under") one is rejected.
GRIDS = {
    "symbols_over": tuple(round(1.0 - 0.02 * i, 4) for i in range(50)),
    "dup_lines_over": tuple(round(1.0 - 0.02 * i, 4) for i in range(50)),
    "repeats_over": tuple(round(0.5 - 0.01 * i, 4) for i in range(50)),
    "upper_over": tuple(round(1.0 - 0.02 * i, 4) for i in range(50)),
    "distinct_under": tuple(round(0.02 * i, 4) for i in range(50)),
    "word_length_over": tuple(round(25 - 0.4 * i, 4) for i in range(50)),
}
_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_distinct bigint"


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of a text, in the order of ``_COUNTS``."""
    text = text or ""
    words = text.encode().split()  # bytes: just the six ASCII white-space characters
    gaps = sum(map(text.count, "\t\n\x0b\x0c\r "))
    seen, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip("\t\x0b\x0c\r "):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if len(words) > 2:
        windows = list(zip(words, words[1:], words[2:]))
        often = Counter(windows)
        if len(often) < len(windows):
            end = 0  # first word not counted yet
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    lower = text.lower()
    if len(lower) == len(text):
        a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (text, lower))
        upper = int(np.count_nonzero(a != b))
    else:
        upper = sum(map(str.isupper, text))
    return len(words), len(text) - gaps, sum(map(text.count, "#*$%&|<>")), dup, repeat, n_lines, upper, len(set(words))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = np.array([measure(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, 8)
            names = ["doc_id", *(c.split()[0] for c in _COUNTS.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, i].copy()) for i in range(8))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_COUNTS}")


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _values() -> dict[str, Column]:
    return {
        "symbols_over": _share("n_symbols", "word_chars"),
        "dup_lines_over": _share("n_dup_lines", "n_lines"),
        "repeats_over": _share("n_repeat_words", "n_words"),
        "upper_over": _share("n_upper", "word_chars"),
        "distinct_under": _share("n_distinct", "n_words"),
        "word_length_over": _share("word_chars", "n_words"),
    }


def _stratum() -> Column:
    out = F.lit(len(STRATA))
    for i, most in reversed(list(enumerate(STRATA))):
        out = F.when(F.col("n_words") < most, i).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p with P(Binomial(n, p) <= k) >= delta."""
    if k >= n:
        return 1.0

    def log_tail(p: float) -> float:
        terms = [
            math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k + 1)
        ]
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid <= 0 or log_tail(mid) >= math.log(delta):
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-9:
            break
    return hi


def choose(good: list[int], alpha: float, delta: float) -> int:
    """How many cutoffs of the grid hold; good[i]: good documents that the i mildest cutoffs reject, last all.

    good has the grid's length + 1 numbers.
    """
    n, held = good[-1], 0
    for k in good[:-1]:
        # below k / n no bound can be; the sum is only needed beyond it
        if not n or k / n > alpha or upper_bound(k, n, delta) > alpha:
            break
        held += 1
    return held


def _beyond(name: str, value: Column, cut: Column) -> Column:
    return value > cut if name.endswith("over") else value < cut


def _step(name: str, cuts: Column) -> Column:
    """The first of cuts, from mild to strict, that rejects the value; their number if none does."""
    value = _values()[name]
    return F.size(F.filter(cuts, lambda c: ~_beyond(name, value, c)))


def _proposed(rows: list, grid: tuple[float, ...], name: str) -> list[float]:
    """A cutoff for each of LEVELS from (label, step, count); an infinite one rejects nothing."""
    none = math.inf if name.endswith("over") else -math.inf
    table = {0: Counter(), 1: Counter()}
    for label, step, n in rows:
        table[label][step] += n
    bad, good = (np.cumsum([table[k][i] for i in range(len(grid))]) for k in (0, 1))
    n_good, out = sum(table[1].values()), []
    for share in LEVELS:
        fit = np.flatnonzero(good <= share * n_good)
        most = int(bad[fit[-1]]) if len(fit) and n_good else 0
        out.append(grid[int(np.searchsorted(bad, most))] if most else none)
    return out


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, target: str = "quality") -> dict[int, tuple[int, dict[str, float]]]:
    """{stratum: (level that holds, {measure: cutoff})} from the counts of documents and (doc_id, target)."""
    scratch = Scratch(counts.sparkSession, "cutoffs")
    known = counts.join(labelled(labels, target), "doc_id").where(~base_failed() & F.col("label").isin(0, 1))
    # a fold of its own: not the remainder that other operators hold out by
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(2)) == 1
    known = scratch.keep(known.select("*", _stratum().alias("stratum"), held_out.alias("held_out")))
    steps = [F.struct(F.lit(n).alias("name"), _step(n, F.array(*map(F.lit, g))).alias("step")) for n, g in GRIDS.items()]
    found: dict[tuple[int, str], list] = {}
    for r in known.where("not held_out").select("label", "stratum", F.inline(F.array(*steps))).groupBy("label", "stratum", "name", "step").count().collect():
        found.setdefault((r.stratum, r.name), []).append((r.label, r.step, r["count"]))
    strata = sorted({k for k, _ in found})
    paths = {k: {n: _proposed(found[k, n], GRIDS[n], n) for n in GRIDS} for k in strata}
    # the first level at which any measure rejects a document of the holdout
    level = F.lit(len(LEVELS))
    for k in strata:
        each = [_step(n, F.array(*map(F.lit, cuts))) for n, cuts in paths[k].items()]
        level = F.when(F.col("stratum") == k, F.least(*each)).otherwise(level)
    table: dict[int, tuple[Counter, Counter]] = {k: (Counter(), Counter()) for k in strata}
    for r in known.where(F.col("held_out") & F.col("stratum").isin(strata)).select("label", "stratum", level.alias("level")).groupBy("label", "stratum", "level").count().collect():
        table[r.stratum][r.label][r.level] += r["count"]
    scratch.drop_all_but()
    out = {}
    for k, (bad, good) in table.items():
        bad_rejected, rejected = (np.cumsum([c[i] for i in range(len(LEVELS))]).tolist() for c in (bad, good))
        held = choose([*rejected, sum(good.values())], alpha, delta / (len(STRATA) + 1))
        if held:
            # a milder level that rejects as many bad documents spares good ones; it has been tested before, so it holds too
            i = bad_rejected.index(bad_rejected[held - 1])
            out[k] = (i, {n: cuts[i] for n, cuts in paths[k].items() if math.isfinite(cuts[i])})
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the stratum and its level of every row (null: no cutoffs hold there)."""
    counts = Scratch(docs.sparkSession, "rules").keep(measures(docs))
    rejected, level = F.lit(False), F.lit(None).cast("int")
    for stratum, (i, cuts) in cutoffs(counts, labels, alpha, delta).items():
        level = F.when(_stratum() == stratum, i).otherwise(level)
        for name, cut in cuts.items():
            rejected = rejected | ((_stratum() == stratum) & _beyond(name, _values()[name], F.lit(cut)))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), _stratum().alias("stratum"), level.alias("level"),
    )
