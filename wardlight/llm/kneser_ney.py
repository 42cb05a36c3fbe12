"""Quality by the perplexity of an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Symbols: a code point below PLAIN is a symbol of its own; any other is two symbols, its upper and its lower part, so every script keeps all of its characters. Counting: every task counts the n-grams of its
documents and Spark adds them up; all n-grams of the corpus are counted, those of trusted texts apart. Model: continuation counts, discounts from counts of counts, context sums and
back-off weights are aggregations and joins on n-grams and contexts, sharded by Spark; they end in the log-probability of every n-gram that occurs in the corpus. Scoring: a document's n-grams
with their counts are joined to that table by n-gram and summed by document. The most frequent n-grams, HEAD_GRAMS at most whatever the corpus, would be hot keys of that join: these are sent to the workers
and summed where the document is read. Thresholds: a quantile of the trusted documents of a language that the model didn't learn from.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import batch_rows, binned_quantiles, materialize, scratch, slices, small

#: Length of the n-grams, and bits of a symbol in a packed n-gram.
ORDER, BITS = 5, 12
#: Symbols: 0 and 1 begin and end a text, then PLAIN code points, the upper parts (1,088 of 1,024 code points) and the lower parts of all others.
PLAIN, LOW_BITS = 1980, 10
UPPER = 2 + PLAIN
LOWER = UPPER + (0x110000 >> LOW_BITS)
#: The most frequent n-grams of the corpus that every worker holds (12 bytes each).
HEAD_GRAMS = 2_000_000
#: N-grams that a task gathers before it hands them on.
GATHERED = 700_000
#: Characters from which on a text's threshold is no wider, and the number of a language's set-aside documents at which its own quantile weighs as much as that of all languages.
FULL_CHARS, OWN_THRESHOLD = 1500, 50


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    far = points >= PLAIN
    if not far.any():
        return points + 2
    out = np.zeros(len(points) + int(far.sum()), np.int64)
    at = np.arange(len(points)) + np.cumsum(far) - far
    out[at] = np.where(far, UPPER + (points >> LOW_BITS), points + 2)
    out[at[far] + 1] = LOWER + (points[far] & ((1 << LOW_BITS) - 1))
    return out


def packed_grams(text: str) -> np.ndarray:
    """The packed n-grams of a text, one for each of its symbols and its end."""
    own = symbols_of(text)
    symbols = np.zeros(len(own) + ORDER, np.int64)
    symbols[ORDER - 1 : -1] = own
    symbols[-1] = 1
    grams = np.zeros(len(own) + 1, np.int64)
    for i in range(ORDER):
        grams = grams << BITS | symbols[i : i + len(grams)]
    return grams


def count_grams(docs: DataFrame, text_col: str, learn_col: str) -> DataFrame:
    """(g, c, t): every n-gram of docs, its count in the documents to learn from and in all, in parts to be added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            both = np.concatenate(counts)
            return k, np.stack([np.bincount(inverse, both[:, i]).astype(np.int64) for i in (0, 1)], 1)

        def rows(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (k, c[:, 0], c[:, 1])], ["g", "c", "t"])

        for batch in slices(batches, 300):
            for learn in (True, False):
                grams = [packed_grams(t) for t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and bool(own) is learn]
                if grams:
                    k, c = np.unique(np.concatenate(grams), return_counts=True)
                    keys.append(k)
                    counts.append(np.stack([c if learn else np.zeros(len(k), np.int64), c], 1))
                    held += len(k)
            if held > GATHERED:
                k, c = merged()
                if len(k) > GATHERED // 2:
                    yield from rows(k, c)
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [k], [c], len(k)
        if keys:
            yield from rows(*merged())

    return docs.select(text_col, learn_col).mapInArrow(count, "g long, c long, t long")


def suffix(g: Column, length: int) -> Column:
    return g.bitwiseAND(F.lit((1 << BITS * length) - 1))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and 3 or more, from how many n-grams have the counts 1 to 4; fixed ones where too few have."""
    return discounts_of([x or 0 for x in counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()])


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2 for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(g, t, logp) for every n-gram of (g, c, t): interpolated modified Kneser-Ney from those with c > 0."""
    counted = {ORDER: grams.where("c > 0").select("g", "c")}
    wanted = {ORDER: grams.select("g", "t")}
    for k in range(ORDER - 1, 0, -1):
        counted[k] = materialize(counted[k + 1].groupBy(suffix(F.col("g"), k).alias("g")).agg(F.count(F.lit(1)).alias("c")))
        wanted[k] = materialize(wanted[k + 1].select(suffix(F.col("g"), k).alias("g")).distinct().withColumn("t", F.lit(0).cast("long")))
    lower = wanted[1].select(F.lit(0).cast("long").alias("tail"), F.lit(1.0 / (1 << BITS)).alias("lower")).limit(1)
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counted[k])
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.shiftrightunsigned("g", BITS)
        sums = counted[k].groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(taken).alias("freed"))
        asked = wanted[k].join(counted[k], "g", "left").withColumn("context", context).withColumn("tail", suffix(F.col("g"), k - 1))
        asked = asked.join(sums, "context", "left").join(F.broadcast(lower) if k == 1 else lower, "tail")
        own = F.coalesce((F.col("c") - taken) / F.col("total"), F.lit(0.0))
        back = F.coalesce(F.col("freed") / F.col("total"), F.lit(1.0))
        p = materialize(asked.select("g", "t", (own + back * F.col("lower")).alias("p")))
        lower = p.select(F.col("g").alias("tail"), F.col("p").alias("lower"))
    return p.select("g", "t", F.log("p").cast("float").alias("logp"))


class Lookup:
    """Log-probabilities by n-gram: open addressing in arrays 1.7 times as long as the table."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        self.size = 256 + int(1.7 * len(grams))
        self.keys = np.full(self.size, -1, np.int64)
        self.logs = np.zeros(self.size, np.float32)
        left, values = grams, logs
        at = self._slots(left)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = left[free]  # of several for one slot the last stays
            mine = self.keys[at] == left
            self.logs[at[mine]] = values[mine]
            left, values, at = left[~mine], values[~mine], (at[~mine] + 1) % self.size

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(self.size) >> np.uint64(32)).astype(np.int64)

    def sum(self, grams: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of the logs of those n-grams that the table has, and the others."""
        total, at, absent = 0.0, self._slots(grams), []
        while len(grams):
            there = self.keys[at]
            hit = there == grams
            total += float(self.logs[at[hit]].sum(dtype=np.float64))
            if len(lacking := grams[there == -1]):
                absent.append(lacking)
            on = ~hit & (there != -1)
            grams, at = grams[on], (at[on] + 1) % self.size
        return total, np.concatenate(absent) if absent else np.zeros(0, np.int64)


_LOOKUPS: dict[str, Lookup] = {}


def head_level(grams: DataFrame, most: int) -> int:
    """The lowest level (eight to a doubling of the count t) from which on there are no more than `most` n-grams."""
    levels = sorted(grams.groupBy(level_of()).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)  # at most 512 rows
    least, held = 513, 0
    for level, n in levels:
        held += n
        if held > most:
            break
        least = level
    return least


def level_of() -> Column:
    return F.floor(F.log2("t") * 8).cast("int").alias("level")


def score(docs: DataFrame, logs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns keep, n (characters and the end) and logp of every row of docs, from (g, t, logp), which has all of its n-grams."""
    spark = docs.sparkSession
    leveled = logs.withColumn("level", level_of())
    least = head_level(logs, HEAD_GRAMS)
    head = leveled.where(F.col("level") >= least).select("g", "logp").toArrow()  # HEAD_GRAMS rows of 12 bytes at most
    shared = spark.sparkContext.broadcast((head["g"].to_numpy(), head["logp"].to_numpy()))
    mark = uuid.uuid4().hex  # workers outlive a query
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _LOOKUPS:
            _LOOKUPS.clear()
            _LOOKUPS[mark] = Lookup(*shared.value)
        lookup = _LOOKUPS[mark]
        for batch in slices(batches, 300):
            texts = batch.column(len(keep)).to_pylist()
            sums, rare, often, ends = [], [], [], [0]
            for t in texts:
                total, absent = lookup.sum(packed_grams(t)) if t else (None, np.zeros(0, np.int64))
                sums.append(total)
                g, c = np.unique(absent, return_counts=True)
                rare.append(g)
                often.append(c)
                ends.append(ends[-1] + len(g))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (rare, often)], ["g", "c"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([len(t) + 1 if t else 0 for t in texts], pa.int64()), pa.array(sums, pa.float64()), lists], [*keep, "n", "logp", "_rare"])

    summed = docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(add, f"{kinds}, n long, logp double, _rare array<struct<g:bigint,c:bigint>>")
    with batch_rows(spark):
        summed = materialize(summed.withColumn("_row", F.monotonically_increasing_id()))
    rest = summed.where("size(_rare) > 0").select("_row", F.inline("_rare"))
    rest = rest.join(leveled.where(F.col("level") < least).select("g", F.col("logp").alias("_l")), "g")
    rest = materialize(rest.groupBy("_row").agg(F.sum(F.col("c") * F.col("_l").cast("double")).alias("_more")))
    both = summed.drop("_rare").join(small(rest, rest.count()), "_row", "left")
    return both.select(*keep, "n", (F.col("logp") + F.coalesce("_more", F.lit(0.0))).alias("logp"))


def classify(
    docs: DataFrame, labels: DataFrame, quantile: float = 0.999, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", toxic_col: str | None = "toxic",
) -> DataFrame:
    """(doc_id, lang, text_key, n, perplexity, threshold, kept), one row for each row of docs; text_key is xxhash64 of the text.

    labels: ids with a quality (1: trusted) and, if toxic_col is given, a flag that takes the trust away. A fifth of the trusted documents, by a hash of their id, sets the thresholds, the rest
    trains; every copy of a repeated row counts. perplexity is that of a character (and the end). kept: the perplexity is at most the threshold; threshold: for a language the quantile over its share of that
    fifth, drawn towards that over all of it the more the fewer documents it has there (n of them weigh n against OWN_THRESHOLD; a null language has none); the quantile is taken of the distances from the language's median, each times the root of the text's length over FULL_CHARS (1 at most), and the
    threshold of a text is divided by that root, since shorter texts scatter more. Quantiles are exact to 0.0001 of the logarithm. A null or empty text has no perplexity and isn't kept. Without
    trusted documents nothing can be judged: perplexity and threshold are null, every text with a character is kept. An empty table gives no rows.
    """
    good = F.col(quality_col) == 1
    if toxic_col:
        good = good & (F.coalesce(F.col(toxic_col), F.lit(0)) != 1)
    with scratch():
        trusted = labels.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
        trusted = materialize(trusted.withColumn("_role", F.when(F.pmod(F.xxhash64("_id"), F.lit(5)) == 0, "set").otherwise("learn")))
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
        rows = rows.join(small(trusted, trusted.count()), F.col("doc_id") == F.col("_id"), "left").withColumn("_learn", F.coalesce(F.col("_role") == "learn", F.lit(False)))
        with batch_rows(docs.sparkSession):
            grams = materialize(count_grams(rows, "text", "_learn").groupBy("g").agg(F.sum("c").alias("c"), F.sum("t").alias("t")))
        if not grams.where("c > 0").limit(1).count():
            return docs.select(
                F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("text_key"),
                F.when(F.length(text_col) > 0, F.length(text_col) + 1).otherwise(0).cast("long").alias("n"), F.lit(None).cast("double").alias("perplexity"),
                F.lit(None).cast("double").alias("threshold"), F.coalesce(F.length(text_col) > 0, F.lit(False)).alias("kept"),
            )
        logs = materialize(log_probabilities(grams))
        scored = score(rows, logs, "text", ["doc_id", "lang", "text_key", "_role"]).withColumn("loss", -F.col("logp") / F.col("n"))
        scored = materialize(scored.withColumn("_all", F.lit(0)), outer=True)
        wide = F.sqrt(F.least(F.col("n"), F.lit(FULL_CHARS)) / FULL_CHARS)
        setting = scored.where("_role = 'set' and n > 0")

        def thresholds(by: str) -> DataFrame:
            middle = materialize(binned_quantiles(setting, by, "loss", {"m": 0.5}).where(F.col(by).isNotNull()).select(by, "m"))
            off = setting.join(small(middle, middle.count()), by).withColumn("_off", (F.col("loss") - F.col("m")) * wide)
            up = binned_quantiles(off, by, "_off", {"up": quantile})
            return materialize(middle.join(up, by), outer=True)

        by_lang = thresholds("lang").select("lang", "m", "up", (F.col("texts") / (F.col("texts") + OWN_THRESHOLD)).alias("_own"))
        over_all = thresholds("_all").select("_all", F.col("m").alias("_m"), F.col("up").alias("_up"))
        n_langs = by_lang.count()
    judged = scored.join(small(by_lang, n_langs), "lang", "left").join(F.broadcast(over_all), "_all", "left")  # over_all is one row
    own = F.coalesce("_own", F.lit(0.0))
    shrunk = lambda of_lang, of_all: own * F.coalesce(F.col(of_lang), F.col(of_all)) + (1 - own) * F.col(of_all)
    limit = shrunk("m", "_m") + F.greatest(shrunk("up", "_up"), F.lit(0.0)) / wide
    return judged.select(
        "doc_id", "lang", "text_key", "n", F.exp("loss").alias("perplexity"), F.when(F.col("n") > 0, F.exp(limit)).alias("threshold"),
        F.coalesce((F.col("n") > 0) & F.coalesce(F.col("loss") <= limit, F.lit(True)), F.lit(False)).alias("kept"),
    )
