"""Language identification by words first, then shorter and shorter character n-grams.

A model holds, for each language, log frequencies of words and of character n-grams (n from
``longest`` down to 1, word ends marked). A word that the model knows is scored by its log
frequencies; any other by the mean of its known n-grams of the greatest n that has any. A
document's score for a language is the sum over its words; the prediction is the best
language, its score the posterior probability under equal priors.

Training counts words and n-grams of labelled documents in the tasks, and sums them by key.
It may use a bounded sample: about ``max_docs`` documents, chosen by a hash of the id (all,
where there are no more), and keeps the ``max_keys`` words and n-grams that occur most. These bounds keep the model's
size independent of the corpus, so that it can be sent to every task. A run of over LONGEST_WORD characters without white
space is no word to learn. Prediction covers all rows and whole texts.

A null text or one without a letter gives ``und`` with score 0, as does an empty model. A
text whose words say nothing gives the language with the most training words. Null languages
are not learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import coded, settled, slices, sums, texts_of
from .decontam import normal

#: Labelled documents that a model is fitted on, about.
MAX_DOCS = 10_000
#: Occurrences from which a word or n-gram is known.
MIN_COUNT = 3
LONGEST = 4
#: Words and n-grams that a model holds at most, and characters of a word that is learned at most.
MAX_KEYS, LONGEST_WORD = 1_000_000, 200
_SCALE = 1 << 20


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def counts(docs: DataFrame, text: str, lang: str, longest: int = LONGEST) -> DataFrame:
    """(n, key, lang, count): n = 0 for words, else the length of the n-grams."""
    source = docs.select(F.col(text).alias("__text"), F.col(lang).alias("__lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                lens, codes, raw = coded(pc.ascii_split_whitespace(texts_of(part, "__text")))
                langs = pc.dictionary_encode(part.column(1))
                names = langs.dictionary.to_pylist()
                of = np.repeat(np.asarray(langs.indices, np.int64), lens)
                pairs, n = np.unique(of * len(raw) + codes, return_counts=True)
                total: Counter = Counter()
                for pair, c in zip(pairs.tolist(), n.tolist()):
                    word = normal(raw[pair % len(raw)])
                    if len(word) > LONGEST_WORD or not any(map(str.isalpha, word)):
                        continue
                    k = pair // len(raw)
                    total[0, word, k] += c
                    for size in range(1, longest + 1):
                        for g in grams(word, size):
                            total[size, g, k] += c
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in total], pa.int32()), pa.array([x[1] for x in total], pa.string()), pa.array([names[x[2]] for x in total], pa.string()), pa.array(total.values(), pa.int64())],
                    ["n", "key", "lang", "count"],
                )

    return source.mapInArrow(run, "n int, key string, lang string, count long").groupBy("n", "key", "lang").agg(F.sum("count").alias("count"))


class Model:
    """Log frequencies by key; centred, so that 0 is no evidence."""

    def __init__(self, rows: list[tuple[int, str, str, int]]):
        tables: dict[int, dict[str, dict[str, int]]] = {}
        totals: dict[int, Counter] = {}
        for n, key, lang, count in rows:
            tables.setdefault(n, {}).setdefault(key, {})[lang] = count
            totals.setdefault(n, Counter())[lang] += count
        words = totals.get(0, Counter())
        self.langs = sorted(words, key=lambda x: (-words[x], x))
        self.tables: dict[int, dict[str, np.ndarray]] = {}
        for n, table in tables.items():
            size = np.log(np.array([totals[n][x] + 0.5 * len(table) for x in self.langs]))
            c = np.array([[of.get(x, 0) for x in self.langs] for of in table.values()], float)
            logs = np.log(c + 0.5) - size
            logs -= logs.mean(1, keepdims=True)
            self.tables[n] = dict(zip(table, logs.astype(np.float32)))
        self.longest = max(self.tables, default=0)

    def score(self, word: str) -> np.ndarray:
        """Evidence of one normalised word for each language."""
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(self.longest, 0, -1):
            table, marked = self.tables.get(n, {}), f"<{word}>" if n > 1 else word
            total, known = np.zeros(len(self.langs)), 0
            for i in range(len(marked) - n + 1):
                if (v := table.get(marked[i : i + n])) is not None:
                    total += v
                    known += 1
            if known:
                return (total / known).astype(np.float32)
        return np.zeros(len(self.langs), np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, min_count: int = MIN_COUNT, longest: int = LONGEST, max_keys: int = MAX_KEYS) -> Model:
    """Fits a model on the rows of docs with a language, or on about max_docs of them."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = labelled.count()
    if n > max_docs:
        labelled = labelled.filter(F.pmod(F.xxhash64(id_col), F.lit(_SCALE)) < int(_SCALE * max_docs / n))
    table = settled(counts(labelled, text, lang, longest).filter(F.col("count") >= min_count))
    if table.count() > max_keys:
        most = table.groupBy("n", "key").agg(F.sum("count").alias("c")).orderBy(F.desc("c"), "n", "key").limit(max_keys)
        table = table.join(most.select("n", "key"), ["n", "key"], "left_semi")
    return Model([tuple(r) for r in table.collect()])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        none = np.zeros(len(m.langs), np.float32)
        for batch in batches:
            for part in slices(batch, "__text"):
                lens, codes, raw = coded(pc.ascii_split_whitespace(texts_of(part, "__text")))
                letters = np.zeros(len(raw), np.int64)
                known: dict[str, int] = {}
                of = np.zeros(len(raw), np.int64)
                for i, x in enumerate(raw):
                    word = normal(x)
                    if word.isalpha() or any(map(str.isalpha, x)):
                        letters[i] = 1
                    of[i] = known.setdefault(word if letters[i] else "", len(known))
                scores = np.array([m.score(w) if w and m.langs else none for w in known], np.float64).reshape(len(known), len(m.langs))
                flat = of[codes]
                total = np.stack([sums(scores[:, k][flat], lens) for k in range(len(m.langs))], 1) if m.langs else np.zeros((len(lens), 1))
                total = np.round(total, 6)
                best = total.argmax(1)
                odds = np.exp(total - total.max(1, keepdims=True))
                share = (odds.max(1) / odds.sum(1)) if m.langs else np.zeros(len(lens))
                any_ = sums(letters[codes], lens) > 0 if m.langs else np.zeros(len(lens), bool)
                names = [m.langs[b] if a else "und" for a, b in zip(any_.tolist(), best.tolist())] if m.langs else ["und"] * len(lens)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(any_, share, 0.0))], schema.names)

    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether the crc32 of the id's text falls in fold 0 (a null id counts as the empty text)."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds) == 0
