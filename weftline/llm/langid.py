"""Languages of documents and of the parts of mixed ones.

Sparse multinomial logistic regression on TF-IDF character n-grams (within words, with word ends), trained
with follow-the-regularised-leader and elastic-net penalties, then calibrated with a temperature. A sentence is
the sum of its words' vectors over the root of their number, so a word's scores are computed once per task and
looked up afterwards.

Training data: the labelled samples, and a bounded number of documents (:data:`SAMPLE_DOCS`, those with the
smallest hash of their id) whose delivered label the first model confirms; they widen the vocabulary. Of each document
at most :data:`DOC_SENTENCES` sentences evenly spread over the text, of each language at most :data:`LANG_SENTENCES`
are taken. Everything else covers all documents, whole texts.

A text is cut at line breaks and sentence ends. Log lines, addresses, code, numbers and symbols are no
sentences (:func:`sentences`). A sentence takes the language with the highest posterior under the calibrated
temperature and a prior for the document's main language (:data:`SWITCH`), so that one odd sentence needs evidence to
count as another language.

Confidences are posteriors under the calibrated temperature, without that prior. The temperature makes the held-out
documents likeliest (an eighth of them, by a hash of their id, none of whose sentences were trained on). Whole sentences
of held-out documents are told apart nearly without error, so it is fitted to them and to fragments of them, of one
word to half a sentence; :attr:`Model.errors` has the expected calibration error before and after.

Defined results: null, empty and blank texts and texts without any sentence have no language and no parts;
without any labelled sample nothing has a language;
ties go to the language that comes first in :data:`LANGS`; labels are compared after :func:`label_language`.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "ru", "zh")
#: Bound of the documents taken for training beside the labelled samples, and of the samples.
SAMPLE_DOCS, SAMPLE_ROWS = 1500, 20_000
#: Sentences taken of each of these documents, and of each language, for training.
DOC_SENTENCES, LANG_SENTENCES = 40, 400
#: Buckets of hashed n-grams.
BUCKETS = 1 << 17
#: Prior log odds of a sentence being in the document's main language rather than another one (twenty to one), and the
#: scale on which sentences vote for the main language: nearly all for their best one.
SWITCH, VOTE = 3.0, 0.02
#: Characters of a word whose n-grams are made at once, and longest word whose scores are kept.
PIECE, KEPT = 4096, 64

# Names of the languages in labels (ISO 639-1, 639-2/T and /B, English and own names).
NAMES = {
    "en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german", "deutsch"), "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "castilian", "español", "espanol"), "pt": ("pt", "por", "portuguese", "português", "portugues"), "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "flemish", "nederlands"), "sv": ("sv", "swe", "swedish", "svenska"), "ru": ("ru", "rus", "russian", "русский"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语"),
}
_LABEL = {n: k for k, names in NAMES.items() for n in names}
_NOISE = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+|\S*=\S+|<[^<>\s][^<>]*>|\[[A-Z]+\]|\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d\S*|\x1b\[[0-9;]*[A-Za-z]|\b[0-9a-f]{12,}\b", re.I)
_NOISY = re.compile(r"[=@/<\[\x1b]|www\.|[0-9a-fA-F]{12}")
_JSON = re.compile(r"^\s*[\[{].*[\]}]\s*,?\s*$", re.S)
_CUT = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？])[\"'”»」』）]*\s*")
_WORD = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]|[^\W\d_\u3400-\u9fff\uf900-\ufaff]+(?:['’][^\W\d_\u3400-\u9fff\uf900-\ufaff]+)*")
_QUOTED = re.compile(r"(?<=[\w,;:] )[“«][^”»\n]{1,80}[”»]")
_LATIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HAN = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]")
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[Tt\s]\s*\d\d:\d\d", re.I)


def label_language(label: str | None) -> str | None:
    """The code a label stands for in any usual spelling, or None if it names none of :data:`LANGS`."""
    if not label:
        return None
    low = label.strip().lower()
    return _LABEL.get(low) or _LABEL.get(re.split(r"[-_ (]", low, maxsplit=1)[0])


def words_of(text: str) -> list[str]:
    """Lower-case words in composed form; Chinese characters stand alone."""
    return _WORD.findall(unicodedata.normalize("NFC", text).lower())


def sentences(line: str) -> list[list[str]]:
    """The words of each whole sentence or headline of a line."""
    if len(line) < 4 or line.isspace():
        return []
    if _NOISY.search(line) or line.lstrip()[:1] == "{":
        if _JSON.match(line) and '":' in line or _LOG.match(line) and "=" in line:
            return []
        line = _NOISE.sub(" ", line)
    if "“" in line or "«" in line:  # a quoted phrase is no sentence of its own
        bare = _QUOTED.sub(" ", line)
        line = bare if len(bare.split()) > 3 else line
    if line.isascii():
        return [w for part in _CUT.split(line.lower()) if len(w := _LATIN.findall(part)) > 2 and sum(map(len, w)) > 8]
    line = unicodedata.normalize("NFC", line).lower()
    if not _HAN.search(line):
        return [w for part in _CUT.split(line) if len(w := _LATIN.findall(part)) > 2 and sum(map(len, w)) > 8]
    out = []
    for part in _CUT.split(line):
        words = _WORD.findall(part)
        han = sum(1 for w in words if "\u3400" <= w[0] <= "\ufaff")
        if len(words) > (3 if han * 2 > len(words) else 2) and (han or sum(map(len, words)) > 8):
            out.append(words)
    return out


def _grams(word: str) -> list[str]:
    if len(word) == 1 and _HAN.match(word):
        return [word]
    w = f"\u2581{word}\u2581"
    return [w[i : i + n] for n in (1, 2, 3, 4, 5) if n <= len(w) for i in range(len(w) - n + 1) if n > 1 or w[i] != "\u2581"]


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _bucket(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


class Model:
    """Weights, document frequencies and temperature; small enough to travel with a task (see :meth:`pack`)."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float = 1.0, errors: tuple[float, float] | None = None) -> None:
        self.weights, self.bias, self.idf, self.temperature = weights, bias, idf, temperature
        #: Expected calibration error of held-out rows with temperature 1 and with the fitted one.
        self.errors = errors
        self._known: dict[str, int] = {}
        self.table = np.zeros((4096, len(LANGS)), np.float32)

    def pack(self) -> bytes:
        used = np.flatnonzero(np.abs(self.weights).sum(1))
        return json.dumps({"used": used.tolist(), "w": np.round(self.weights[used], 4).tolist(), "idf": np.round(self.idf, 3).tolist(), "b": self.bias.tolist(), "t": self.temperature, "e": self.errors}).encode()

    @staticmethod
    def unpack(data: bytes) -> Model:
        x = json.loads(data)
        w = np.zeros((BUCKETS, len(LANGS)), np.float32)
        w[x["used"]] = x["w"]
        return Model(w, np.array(x["b"], np.float32), np.array(x["idf"], np.float32), x["t"], tuple(x["e"]) if x["e"] else None)

    def rows(self, words: list[str]) -> np.ndarray:
        """Row numbers of words in :attr:`table`, which keeps the scores of the words met so far."""
        known = self._known
        if len(known) > 400_000:
            known.clear()
        out = [known.get(w, -1) for w in words]
        if -1 in out:
            for k, i in enumerate(out):
                if i < 0:
                    w = words[k]
                    if (i := known.get(w, -1)) < 0:
                        i = len(known)
                        known[w if len(w) <= KEPT else f"\x00{i}"] = i  # a very long word is not kept
                        if i >= len(self.table):
                            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                        idx, val = word_vector(w, self.idf)
                        self.table[i] = val @ self.weights[idx]
                    out[k] = i
        return np.array(out)

    def logits(self, found: list[list[str]]) -> np.ndarray:
        """Scores of sentences, one row each; over the temperature they are calibrated logits."""
        n = np.array([len(x) for x in found])
        at = self.rows([w for x in found for w in x])
        total = np.add.reduceat(self.table[at], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
        return total / np.sqrt(n)[:, None] + self.bias


def word_vector(word: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and TF-IDF weights of length 1 of a word's n-grams: one entry per occurrence, or one per bucket for
    words so long that their n-grams are made piece by piece."""
    if len(word) <= PIECE:
        idx = np.array([crc32(g.encode("utf-8", "surrogatepass")) for g in _grams(word)]) % BUCKETS
        val = idf[idx]
        return idx, val / (np.sqrt(val @ val) or 1.0)
    w, count = f"\u2581{word}\u2581", np.zeros(BUCKETS)
    for start in range(0, len(w), PIECE):
        piece = w[start : start + PIECE + 4]
        grams = [piece[i : i + n] for n in (1, 2, 3, 4, 5) for i in range(min(PIECE, len(piece) - n + 1))]
        count += np.bincount([crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams if g != "\u2581"], minlength=BUCKETS)
    idx = np.flatnonzero(count)
    val, times = idf[idx], count[idx]
    return idx, val * times / (np.sqrt(times @ (val * val)) or 1.0)


def _vectors(rows: list[list[str]], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    known: dict[str, tuple] = {}
    out = []
    for words in rows:
        vecs = [known.setdefault(w, None) or known.__setitem__(w, word_vector(w, idf)) or known[w] for w in words]
        idx, inv = np.unique(np.concatenate([v[0] for v in vecs]), return_inverse=True)
        val = np.bincount(inv, np.concatenate([v[1] for v in vecs])) / np.sqrt(len(words))
        out.append((idx, val))
    return out


def train(rows: list[list[str]], labels: list[str], groups: list | None = None, epochs: int = 6, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> Model:
    """FTRL-proximal training (per-coordinate rates, L1 and L2). ``groups`` says which rows belong together (a document);
    an eighth of the groups, by hash, is held out for the temperature. Without groups each row is one."""
    df = np.zeros(BUCKETS)
    for words in rows:
        df[list({_bucket(g) for w in words for g in _grams(w)})] += 1
    idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + 1
    x, y = _vectors(rows, idf), np.array([LANGS.index(k) for k in labels])
    k = len(LANGS)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    held = np.array([crc32(str(g).encode()) % 8 == 7 for g in (groups if groups is not None else range(len(rows)))])
    if held.all():
        held[:] = False
    rng = np.random.default_rng(seed)

    def weights(idx: np.ndarray) -> np.ndarray:
        zi = z[idx]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[idx])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            idx = np.append(x[i][0], BUCKETS)
            val = np.append(x[i][1], 1.0)
            w = weights(idx)
            s = val @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = val[:, None] * p
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    w = weights(np.arange(BUCKETS + 1))
    model = Model(w[:-1].astype(np.float32), w[-1].astype(np.float32), idf)
    if held.any():
        _calibrate(model, [rows[i] for i in np.flatnonzero(held)], y[held], rng)
    return model


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibration_error(p: np.ndarray, truth: np.ndarray, bins: int = 15) -> float:
    """Expected calibration error: how far confidence and share of right answers lie apart, over bins of confidence."""
    sure, right = p.max(1), p.argmax(1) == truth
    at = np.minimum((sure * bins).astype(int), bins - 1)
    n = np.bincount(at, minlength=bins)
    gap = np.abs(np.bincount(at, sure, bins) - np.bincount(at, right, bins))
    return float(gap.sum() / n.sum())


def _calibrate(model: Model, rows: list[list[str]], truth: np.ndarray, rng: np.random.Generator) -> None:
    """The temperature under which held-out sentences and fragments of them are likeliest."""
    parts, kinds = list(rows), list(truth)
    for words, t in zip(rows, truth):
        for size in {1, 2, 3, len(words) // 2} - {0, len(words)}:
            at = int(rng.integers(0, max(1, len(words) - size)))
            parts.append(words[at : at + size])
            kinds.append(t)
    s, t = model.logits(parts).astype(float), np.array(kinds)
    own = np.arange(len(t))
    model.temperature = float(min(np.geomspace(0.02, 20, 140), key=lambda temp: -np.log(np.maximum(_soft(s / temp)[own, t], 1e-300)).mean()))
    model.errors = (calibration_error(_soft(s), t), calibration_error(_soft(s / model.temperature), t))


def _varied(rows: list[list[str]], labels: list[str], groups: list) -> tuple[list[list[str]], list[str], list]:
    """Training rows and the same without accents, as some texts are delivered."""
    extra = [[_plain(w) for w in r] for r in rows]
    keep = [i for i, (a, b) in enumerate(zip(rows, extra)) if a != b and labels[i] != "ru"]
    return rows + [extra[i] for i in keep], labels + [labels[i] for i in keep], groups + [groups[i] for i in keep]


def _document_sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, words``: at most :data:`DOC_SENTENCES` sentences of each document, evenly spread over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                lang = label_language(label)
                if lang is None or not text:
                    continue
                found = [s for line in text.split("\n") for s in sentences(line) if sum(map(len, s)) <= PIECE]
                for s in found[:: -(-len(found) // DOC_SENTENCES) or 1]:
                    for column, x in zip(out, (doc, lang, s)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.string()))], ["doc_id", "lang", "words"])

    return documents.select(F.col("doc_id").cast("bigint"), "lang", "text").mapInArrow(run, "doc_id long, lang string, words array<string>")


def fit(samples: DataFrame, documents: DataFrame | None = None) -> Model:
    """The model from labelled samples (``lang, text``) and a bounded sample of labelled documents."""
    rows, labels, groups = [], [], []
    for r in samples.where("text is not null and lang is not null").orderBy("sample_id").limit(SAMPLE_ROWS).select("sample_id", "lang", "text").collect():
        if (lang := label_language(r.lang)) is not None:
            found = [s for s in [s for line in r.text.split("\n") for s in sentences(line)] or [words_of(r.text)] if s]
            rows += found
            labels += [lang] * len(found)
            groups += [f"s{r.sample_id}"] * len(found)
    if not rows:
        return Model(np.zeros((BUCKETS, len(LANGS)), np.float32), np.zeros(len(LANGS), np.float32), np.ones(BUCKETS, np.float32))
    first = train(*_varied(rows, labels, groups))
    if documents is None:
        return first
    # ids alone are sorted; then the sentences of the chosen documents come, a bounded number of bounded length
    labelled = documents.where("lang is not null and doc_id is not null")
    chosen = [r[0] for r in labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    taken: list[Row] = _document_sentences(labelled.where(F.col("doc_id").isin(chosen))).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    more: dict[str, list[tuple[list[str], int]]] = {k: [] for k in LANGS}
    for r in taken:
        a = first.logits([r.words])[0] / VOTE
        if LANGS[int(a.argmax())] == r.lang and np.exp(a - a.max()).sum() < 1.25:
            more[r.lang].append((r.words, r.doc_id))
    for lang, found in more.items():
        picked = found[:: -(-len(found) // LANG_SENTENCES) or 1]
        rows += [s for s, _ in picked]
        labels += [lang] * len(picked)
        groups += [f"d{d}" for _, d in picked]
    return train(*_varied(rows, labels, groups), epochs=3)


def judge(model: Model, texts: list[str | None]) -> tuple[list[str | None], list[float], list[list[tuple[int, str, float]]]]:
    """Of each text its main language, its confidence, and (line, language, confidence) of its sentences."""
    found, line_no, doc = [], [], []
    for d, text in enumerate(texts):
        if text:
            for k, line in enumerate(text.split("\n"), 1):
                for s in sentences(line):
                    found.append(s)
                    line_no.append(k)
                    doc.append(d)
    langs: list[str | None] = [None] * len(texts)
    conf, parts = [0.0] * len(texts), [[] for _ in texts]
    if not found or not model.weights.any():
        return langs, conf, parts
    k = len(LANGS)
    scores, at = model.logits(found), np.array(doc)
    size = np.array([sum(map(len, s)) for s in found], float)

    mass = np.zeros((len(texts), k))
    np.add.at(mass, at, _soft(scores / VOTE) * size[:, None])
    scores = scores / model.temperature
    q = _soft(scores)
    scores[np.arange(len(at)), mass.argmax(1)[at]] += SWITCH
    best = scores.argmax(1)
    share = np.bincount(at * k + best, size, len(texts) * k).reshape(-1, k)
    main = share.argmax(1)
    sure = q[np.arange(len(at)), best]
    own = best == main[at]
    total = np.bincount(at[own], (sure * size)[own], len(texts)) / np.maximum(1e-9, np.bincount(at[own], size[own], len(texts)))
    for d in set(doc):
        langs[d], conf[d] = LANGS[main[d]], float(total[d])
    for d, n, b, c in zip(doc, line_no, best.tolist(), sure.tolist()):
        parts[d].append((n, LANGS[b], c))
    return langs, conf, parts


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, label, main, confidence, parts array<struct<line_no, lang, confidence>>`` of every document.

    ``parts`` has one element per line and language; documents without sentences have null ``main``.
    """
    data = documents.sparkSession.sparkContext.broadcast(model.pack())  # a model, its size fixed by BUCKETS
    schema = "doc_id long, label string, main string, confidence double, parts array<struct<line_no:long,lang:string,confidence:double>>"
    part = pa.struct([("line_no", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())])
    arrow = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("main", pa.string()), ("confidence", pa.float64()), ("parts", pa.list_(pa.field("element", part)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.unpack(data.value)
        for batch in batches:
            ids, labels, texts = (c.to_pylist() for c in batch.columns)
            mains, sure, parts = judge(known, texts)
            lines: list[list] = [[], [], []]
            offsets = [0]
            for found in parts:
                best: dict[tuple[int, str], float] = {}
                for line, code, c in found:
                    if c > best.get((line, code), 0.0):
                        best[line, code] = c
                for (line, code), c in best.items():
                    lines[0].append(line)
                    lines[1].append(code)
                    lines[2].append(c)
                offsets.append(len(lines[0]))
            items = pa.StructArray.from_arrays([pa.array(lines[0], pa.int64()), pa.array(lines[1], pa.string()), pa.array(lines[2], pa.float64())], fields=list(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([label_language(x) for x in labels], pa.string()), pa.array(mains, pa.string()), pa.array(sure, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items).cast(arrow.field("parts").type)], schema=arrow)

    return documents.select(F.col("doc_id").cast("bigint"), "lang", "text").mapInArrow(run, schema)


def relabelled(found: DataFrame) -> DataFrame:
    """``doc_id, line_no, lang`` of the documents whose label is missing or wrong or whose parts differ."""
    langs = F.array_distinct(F.transform("parts", lambda p: p["lang"]))
    wrong = F.col("main").isNotNull() & (~F.col("label").eqNullSafe(F.col("main")) | (F.size(langs) > 1))
    return found.where(wrong).select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.line_no", "p.lang")
