"""Missing or wrong language labels (problem 10): string-kernel classification of every block of a mail.

The kernel of two texts is the number of character n-grams, n = 2 to 4, that both have (blended spectrum, presence), divided by
the root of the product of their own numbers. Landmarks are a sample of the labelled texts (Nystroem); one-versus-rest ridge regression in the
landmarks' feature space gives a coefficient for each landmark and language. Scoring a batch of texts is the matrix product (texts by
n-grams) (n-grams by landmarks) (landmarks by languages); the last two factors don't depend on the text and are multiplied once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.mail import units
from motifloom.session import read

SPECTRUM = (2, 3, 4)
TRAIN_ROWS, LANDMARKS, RIDGE = 5_000, 300, 1e-2
SHARPNESS = 12.0
LEAST_WORDS = 8
_NOT_TEXT = re.compile(r"\S+@\S+|https?://\S+")

# Spellings of the labels, ISO 639 codes and English names.
LABELS = {
    "de": "de", "deu": "de", "ger": "de", "german": "de",
    "en": "en", "eng": "en", "english": "en",
    "es": "es", "spa": "es", "spanish": "es",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "it": "it", "ita": "it", "italian": "it",
    "nl": "nl", "nld": "nl", "dut": "nl", "dutch": "nl",
}


def _letters() -> np.ndarray:
    """Code of every character of the basic plane: 0 for what is no letter, 1-26 for a-z, then letters with marks, 62 for all others."""
    codes = np.zeros(1 << 16, dtype=np.uint8)
    marked = {c: 27 + i for i, c in enumerate("ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ")}
    for x in range(1 << 16):
        c = chr(x).lower()
        if len(c) == 1 and c.isalpha():
            codes[x] = ord(c) - 96 if "a" <= c <= "z" else marked.get(c, 62)
    return codes


_CODES: np.ndarray | None = None
_BASE = {2: 0, 3: 1 << 12, 4: (1 << 12) + (1 << 18)}
_GRAMS = (1 << 12) + (1 << 18) + (1 << 24)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, n-gram) of the distinct n-grams of every text, ordered, and the number of words of every text."""
    global _CODES
    if _CODES is None:
        _CODES = _letters()
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    codes = _CODES[np.minimum(points, 0xFFFF)]
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes), [len(texts) - 1]])[: len(codes)]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)  # runs of other characters count as one space
    codes, owner = codes[keep].astype(np.uint32), owner[keep]
    begins = np.flatnonzero((codes[1:] != 0) & (codes[:-1] == 0))
    words = np.bincount(owner[begins + 1], minlength=len(texts))
    keys = []
    for n in SPECTRUM:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        g = codes[:m].copy()
        for k in range(1, n):
            g = (g << 6) | codes[k : k + m]
        # a text begins with the space before it and ends with the one behind it
        same = (owner[:m] == owner[n - 1 :]) | ((codes[:m] == 0) & (owner[1 : m + 1] == owner[n - 1 :]))
        own = owner[1 : m + 1] if n > 1 else owner
        keys.append((own[same].astype(np.uint64) << np.uint64(25)) | (g[same].astype(np.uint64) + np.uint64(_BASE[n])))
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key >> np.uint64(25)).astype(np.int64), (key & np.uint64((1 << 25) - 1)).astype(np.int64), words


class KernelModel:
    """Ridge regression on Nystroem features of the n-gram presence kernel."""

    def __init__(self, texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.languages = sorted(set(labels))
        text, gram, _ = grams(texts)
        known, col = np.unique(gram, return_inverse=True)
        norm = np.sqrt(np.maximum(np.bincount(text, minlength=len(texts)), 1))
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        marks = np.arange(0, len(texts), max(1, len(texts) // landmarks))[:landmarks]
        k_xm = np.zeros((len(texts), len(marks)))
        has = np.zeros(len(known), dtype=bool)
        for k, m in enumerate(marks):  # the n-grams of a text are kept as lists, so memory grows with the texts and not with all n-grams
            mine = col[first[m] : first[m + 1]]
            has[mine] = True
            k_xm[:, k] = np.bincount(text, has[col], minlength=len(texts)) / (norm * norm[m])
            has[mine] = False
        value, vector = np.linalg.eigh(k_xm[marks])
        kept = value > 1e-6 * value.max()
        root = vector[:, kept] / np.sqrt(value[kept])
        z = k_xm @ root
        y = np.array([[1.0 if lang == a else -1.0 for a in self.languages] for lang in labels])
        w = np.linalg.solve(z.T @ z + ridge * len(texts) * np.eye(z.shape[1]) / 100, z.T @ y)
        self.known = known.astype(np.int64)
        of_mark = (root @ w) / norm[marks][:, None]
        self.weights = np.zeros((len(known), len(self.languages)), dtype=np.float32)  # n-grams by languages
        for k, m in enumerate(marks):
            self.weights[col[first[m] : first[m + 1]]] += of_mark[k]
        self._row: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_row": None}

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores by text and language, number of words of each text)."""
        if self._row is None:
            self._row = np.zeros(_GRAMS, dtype=np.uint16 if len(self.known) < 65_535 else np.uint32)
            self._row[self.known] = np.arange(1, len(self.known) + 1)
        text, gram, words = grams(texts)
        total = np.bincount(text, minlength=len(texts))
        row = self._row[gram]
        hit = row > 0
        text, row = text[hit], row[hit].astype(np.int64) - 1
        # (texts by n-grams, sparse) times (n-grams by languages): the rows of a text's n-grams are summed
        out = np.zeros((len(texts), len(self.languages)))
        begin = np.searchsorted(text, np.arange(len(texts)))
        some = np.flatnonzero(np.bincount(text, minlength=len(texts)))
        if len(some):
            out[some] = np.add.reduceat(self.weights[row], begin[some], axis=0)
        return out / np.sqrt(np.maximum(total, 1))[:, None], words

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, confidence in 0..1, number of words) of every text."""
        s, words = self.scores(texts)
        p = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
        return s.argmax(axis=1), 1 / p.sum(axis=1), words


def fit(samples: DataFrame, text: str, label: str, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> KernelModel:
    """A model from at most ``train_rows`` labelled rows, chosen by a hash of the text; rows with a null are left out."""
    rows = samples.select(F.col(text).alias("t"), F.col(label).alias("l")).dropna().distinct().orderBy(F.md5("t"), "l").limit(train_rows).collect()
    if not rows:
        raise ValueError("no labelled text")
    return KernelModel([r["t"] for r in rows], [r["l"] for r in rows], landmarks)


def _segments(model: KernelModel, least_words: int, piece_chars: int = 1_000_000):
    def label(ids, held):
        lang, conf, words = model.classify([t for _, _, t in held])
        prose = words >= least_words
        at = [i for i in range(len(held)) if prose[i]]
        cols = [
            ids.take(pa.array([held[i][0] for i in at], pa.int64())), pa.array([held[i][1] for i in at], pa.int32()),
            pa.array([model.languages[lang[i]] for i in at], pa.string()), pa.array(conf[at].astype(np.float64)), pa.array(words[at].astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["id", "segment", "lang", "confidence", "n_words"])

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for d in range(batch.num_rows):
                merged: dict[int, str] = {}
                for u in units(batch.column(1)[d].as_py()):
                    if u.kind == "body":
                        merged[u.block] = f"{merged[u.block]}\n{u.text}" if u.block in merged else u.text
                for k, t in merged.items():
                    held.append((d, k, _NOT_TEXT.sub(" ", t) if "@" in t or "://" in t else t))
                    size += len(t)
                if size > piece_chars:
                    yield label(batch.column(0), held)
                    held, size = [], 0
            if held:
                yield label(batch.column(0), held)

    return run


def prose_languages(docs: DataFrame, id_: str, text: str, model: KernelModel, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, segment, lang, confidence, n_words) of every prose block of every mail; segment is the block's number, 0 the mail header.

    A prose block has at least ``least_words`` words after transfer encoding, HTML and addresses are taken off; heads, boundaries and
    base64 are no prose. Null ids or texts and mails without prose have no rows; repeated rows come out each time.
    """
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).dropna()
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_segments(model, least_words), f"id {kind}, segment int, lang string, confidence double, n_words int")


def label_language(label: str = "lang"):
    """The language that a label names in whatever spelling; null if it names none of those known."""
    first = F.lower(F.split(F.trim(label), "[-_]")[0])
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[first]


def document_languages(docs: DataFrame, id_: str, text: str, label: str, model: KernelModel) -> DataFrame:
    """(id, segment, lang, confidence, label_ok): segment 0 with the mail's main language, that of most words of its prose, and one row for
    each prose block in another language. label_ok tells on segment 0 whether the label names the main language; it is false for a
    null, empty or unknown label. Ties of the main language go to the one that comes first in the alphabet. Ids are unique."""
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"), label_language(F.col(label)).alias("label"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    # the blocks of a mail come out of one task one after another, so the main language needs no shuffle of the corpus
    out = parts.mapInArrow(_with_main(model, LEAST_WORDS), f"id {kind}, segment int, lang string, confidence double, main boolean, label string")
    ok = F.when(F.col("main"), F.coalesce(F.col("label") == F.col("lang"), F.lit(False)))
    return out.select("id", "segment", "lang", "confidence", ok.alias("label_ok"))


def _with_main(model: KernelModel, least_words: int):
    blocks = _segments(model, least_words)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            place = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], names=["id", "text"])
            found = list(blocks([place]))
            if not found:
                continue
            t = pa.Table.from_batches(found)
            doc, words, conf = t["id"].to_numpy(), t["n_words"].to_numpy().astype(np.int64), t["confidence"].to_numpy()
            names = np.array(sorted(model.languages))
            lang = np.searchsorted(names, np.array(t["lang"].to_pylist()))
            n = batch.num_rows
            by = np.zeros((n, len(names)), dtype=np.int64)
            np.add.at(by, (doc, lang), words)
            sure = np.zeros((n, len(names)))
            np.add.at(sure, (doc, lang), words * conf)
            main, any_ = by.argmax(axis=1), np.flatnonzero(by.any(axis=1))
            other = np.flatnonzero(lang != main[doc])
            at = np.concatenate([any_, doc[other]])
            code = np.concatenate([main[any_], lang[other]])
            is_main = np.concatenate([np.ones(len(any_), bool), np.zeros(len(other), bool)])
            confidence = np.concatenate([sure[any_, main[any_]] / by[any_].sum(axis=1), conf[other]])
            segment = np.concatenate([np.zeros(len(any_), np.int32), t["segment"].to_numpy()[other].astype(np.int32)])
            idx = pa.array(at)
            cols = [batch.column(0).take(idx), pa.array(segment), pa.array(names[code].tolist(), pa.string()), pa.array(confidence), pa.array(is_main), batch.column(2).take(idx)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "segment", "lang", "confidence", "main", "label"])

    return run


def _languages(spark, sf_dir):
    model = fit(read(spark, sf_dir, "lang_samples"), "text", "lang")
    return document_languages(read(spark, sf_dir, "documents"), "doc_id", "text", "lang", model).withColumnRenamed("id", "doc_id")


def p10_found(spark, sf_dir):
    return _languages(spark, sf_dir).filter((F.col("segment") > 0) | ~F.col("label_ok")).select("doc_id", "segment", "lang")


def p10_languages(spark, sf_dir):
    return _languages(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


QUERIES = {"p10_found": p10_found, "p10_languages": p10_languages}
SQL: dict[str, str] = {}
