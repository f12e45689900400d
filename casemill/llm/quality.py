"""Quality rules: fixed rules first, then an isolation forest on the rules' statistics.

A text's statistics (one pass, whole text) are a point; random splits isolate unusual points
early, so short path lengths mark anomalous documents (Liu, Ting and Zhou 2008). Trees are
grown on one half of the labelled rows, its good ones, with splits drawn over the box that its rows fill, so
that regions without good rows are cut off early. The score above which a document is dropped
is calibrated on the other half. Both come from a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import documents, keep, small_batches, spread

#: Symbols that the base counts; words of a repeated window.
SYMBOLS, WINDOW = b"#*$%&|<>", 8
#: Base rules: fewest words, most repeated words in 100.
FEWEST_WORDS, MOST_REPEATED = 20, 30
#: Labelled rows that the forest and its threshold are fitted on, at most.
LABELLED = 6000
#: Trees, rows of a tree, seed.
TREES, TREE_ROWS, SEED = 128, 256, 11
#: Splits on a path, at most.
DEEPEST = 12
#: Share of the labelled good rows that the threshold may drop.
MOST_GOOD_LOST = 0.005

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: Windows from which on words are compared by hashes, so that memory is some numbers for each word.
MANY_WINDOWS = 4096
#: Odd multipliers of the two 64-bit hashes of a window.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: The point of a text: square roots of rates, so that a text's length alone is no anomaly, and the logarithm of the mean word length.
FEATURES = ("symbol_rate", "upper_rate", "mark_rate", "dup_line_rate", "repeat_rate", "word_length")

_SPACES = b" \t\n\r\x0b\x0c"
_MARKS = b"!?;:~^_=+@/\\{}[]\"`"
_UPPER = bytes(range(65, 91))


def _views(words: list[bytes], window: int) -> list[bytes]:
    """The text of each window."""
    joined, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    starts = [0, *(e + 1 for e in ends)]
    return [joined[i:j] for i, j in zip(starts, ends[window - 1 :])]


def _repeated_views(words: list[bytes], window: int) -> np.ndarray:
    """Places of windows that occur twice or more, by their text."""
    views = _views(words, window)
    if len(set(views)) == len(views):
        return np.zeros(0, dtype=np.int64)
    seen: dict[bytes, int] = {}
    twice = np.zeros(len(views), dtype=bool)
    for i, v in enumerate(views):
        first = seen.setdefault(v, i)
        if first != i:
            twice[i] = twice[first] = True
    return np.flatnonzero(twice)


def _repeated_hashes(words: list[bytes], window: int) -> np.ndarray:
    """The same by 128-bit rolling hashes: polynomials of the words' hashes."""
    from xxhash import xxh64_intdigest

    n = len(words) - window + 1
    halves = []
    for seed, base in enumerate(BASES):
        hashed = np.fromiter((xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))
        whole = hashed[:n].copy()
        for k in range(1, window):
            whole = whole * base + hashed[k : k + n]
        halves.append(whole)
    order = np.lexsort(halves)
    same = (halves[0][order[1:]] == halves[0][order[:-1]]) & (halves[1][order[1:]] == halves[1][order[:-1]])
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return np.flatnonzero(twice)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words within windows that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    at = (_repeated_views if n < MANY_WINDOWS else _repeated_hashes)(words, window)
    return int(window + np.minimum(np.diff(at), window).sum()) if len(at) else 0


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; a null one counts as empty."""
    data = (text or "").encode()
    words = data.split()
    letters = data.translate(None, _SPACES)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    kept = lambda drop: len(letters) - len(letters.translate(None, drop))
    return (
        len(words),
        len(text or "") - (len(data) - len(letters)),
        kept(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        kept(_UPPER),
        kept(_MARKS),
    )


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *COUNTS) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            columns = zip(*rows) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}")


def points(counts: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of rows of COUNTS."""
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    chars, words, lines = (np.maximum(c[k], 1) for k in ("word_chars", "n_words", "n_lines"))
    rates = [c["n_symbols"] / chars, c["n_upper"] / chars, c["n_marks"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words]
    return np.stack([*map(np.sqrt, rates), np.log1p(c["word_chars"] / words)], axis=1)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as arrays: feature (-1 at a leaf), split, children, and path length at leaves."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        random = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        self.norm = max(_expected(size), 1e-9)
        self.trees = [self._grow(rows[random.choice(len(rows), size, replace=False)], low, high, random) for _ in range(trees)]

    @staticmethod
    def _grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, random) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def node(part: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _expected(len(part))])
            wide = np.flatnonzero(high > low)
            if depth < DEEPEST and len(part) > 1 and len(wide):
                feature = int(random.choice(wide))
                split = float(random.uniform(low[feature], high[feature]))
                below, ends, begins = part[:, feature] < split, high.copy(), low.copy()
                ends[feature] = begins[feature] = split
                nodes[at][:4] = [feature, split, node(part[below], low, ends, depth + 1), node(part[~below], begins, high, depth + 1)]
            return at

        node(rows, low, high, 0)
        table = np.array(nodes)
        return table[:, 0].astype(np.int32), table[:, 1], table[:, 2].astype(np.int32), table[:, 3].astype(np.int32), table[:, 4]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected one): near 1 for anomalies, near 0.4 for the usual."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, left, right, length in self.trees:
            at = np.zeros(len(rows), dtype=np.int32)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = rows[every, np.maximum(f, 0)] < split[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += length[at]
        return np.exp2(-total / (len(self.trees) * self.norm))


def calibrate(scores: np.ndarray, good: np.ndarray, most_lost: float = MOST_GOOD_LOST) -> float:
    """The threshold (drop above it) that drops the most bad rows less good rows, losing at most a share of the good."""
    candidates = np.unique(scores)
    good_scores, bad_scores = np.sort(scores[good]), np.sort(scores[~good])
    lost = 1 - np.searchsorted(good_scores, candidates, "right") / max(1, len(good_scores))
    caught = 1 - np.searchsorted(bad_scores, candidates, "right") / max(1, len(bad_scores))
    value = np.where(lost <= most_lost, caught - lost, -1.0)
    best = int(len(value) - 1 - np.argmax(value[::-1]))
    return float(candidates[best] + candidates[best + 1]) / 2 if best + 1 < len(candidates) else float("inf")


def labelled_rows(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", most: int = LABELLED) -> DataFrame:
    """(id, good, *COUNTS) of at most `most` labelled ids, those with the least hashes, one row each.

    Rows without a label teach nothing; of several labels for an id the least counts, of several texts the one with the least statistics.
    """
    labelled = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.min(label_col).alias("good"))
    sample = labelled.orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(most)
    found = stats.join(F.broadcast(sample), "id").groupBy("id").agg(F.first("good").alias("good"), F.min(F.struct(*COUNTS)).alias("counts"))
    return found.select("id", "good", "counts.*")


def fit_rows(table: np.ndarray, good: np.ndarray, grown: np.ndarray) -> tuple[Forest, float] | None:
    """Forest from the good rows among `grown`, threshold from the others. None if no row to grow on is good.

    Where no other row is labelled (a handful of labels), the threshold comes from the grown rows themselves.
    """
    if not (good & grown).any():
        return None
    forest = Forest(table[good & grown], table[grown].min(axis=0), table[grown].max(axis=0))
    rest = ~grown if (good & ~grown).any() else grown
    return forest, calibrate(forest.score(table[rest]), good[rest])


def fit(stats: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", most: int = LABELLED) -> tuple[Forest, float] | None:
    """Forest and threshold from `labelled_rows`, which are halved by a hash of the id; at most `most` rows reach the driver."""
    half = F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)) == 0
    rows = labelled_rows(stats, labels, label_id, label_col, most).withColumn("grown", half).orderBy("id").toPandas()
    if not len(rows):
        return None
    return fit_rows(points({k: rows[k].to_numpy() for k in COUNTS}), rows["good"].to_numpy() > 0, rows["grown"].to_numpy(dtype=bool))


def judge(stats: DataFrame, fitted: tuple[Forest, float] | None) -> DataFrame:
    """Adds base_failed, score and kept to rows of statistics. Without a forest the base rules decide."""

    def run(batches):
        for batch in batches:
            counts = {k: batch.column(i + 1).to_numpy() for i, k in enumerate(COUNTS)}
            failed = (counts["n_words"] < FEWEST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
            scores = fitted[0].score(points(counts)) if fitted and batch.num_rows else np.zeros(batch.num_rows)
            kept = ~failed & (scores <= (fitted[1] if fitted else 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(scores), pa.array(kept)], names=[*batch.schema.names, "base_failed", "score", "kept"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return stats.select("id", *COUNTS).mapInArrow(run, f"{fields}, base_failed boolean, score double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, COUNTS, base_failed, score, kept.

    Null and empty texts have counts of zero and fail the base; repeated rows are judged
    alike; very long texts are read whole; an empty table gives an empty result. Without labels the base rules decide alone.
    Other columns are not read, so their names may clash.
    """
    stats = keep(rule_statistics(docs, id_col, text_col))
    return judge(stats, fit(stats, labels)).withColumnRenamed("id", id_col)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(spread(documents(spark, sf_dir)), labels).select("doc_id", *COUNTS[:5], "base_failed", "kept", "score")


QUERIES = {"op3_quality": op3_quality}
ORACLE: dict[str, str] = {}
