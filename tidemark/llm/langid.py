"""Language identification by language-bitmask n-gram filters.

All languages share one Bloom filter whose cells are bit masks, one bit a language: the filters of
the languages are its bit slices. The AND of an n-gram's cells is the set of all languages that
hold it, so one probe asks every language at once. A text's votes are the popcounts of each slice
over its n-grams, corrected by the slice's false-positive rate; the highest corrected count decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, lean, outer_id, raw_bytes, short_batches, slices

UNDETERMINED = "und"
PIECE = 1 << 20  # characters of a text at once


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the n-grams of letters and word ends, n-grams of each text, letters of each text)."""
    flat = np.frombuffer(" ".join(["", *(t.lower() for t in texts), ""]).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t.lower()) for t in texts], np.int64)
    letter = _letters()[flat]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one space after each run of letters
    owner = np.zeros(len(flat), np.int64)
    owner[np.cumsum(np.r_[1, sizes + 1])[:-1]] = 1  # a text begins after its separator
    owner = np.cumsum(owner) - 1
    code = np.where(letter, flat, 32)[keep].astype(np.uint64)
    owner_kept = owner[keep]
    counts = np.bincount(owner[letter], minlength=len(texts))
    if len(code) < n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), counts
    h = _hashes(code, n)
    # an n-gram may start at the space before a text's first letter, and ends within the text
    last = owner_kept[n - 1 :]
    first = owner_kept[1 : len(code) - n + 2] if n > 1 else last
    inside = (first == last) & (last >= 0)
    return h[inside], np.bincount(last[inside], minlength=len(texts)), counts


def _hashes(code: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(code) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _pieces(text: str, n: int):
    """(hashes of the n-grams, letters) of one long text, piece by piece: the same as _grams finds in all of it."""
    held, after, at = np.full(int(n > 1), 32, np.uint64), False, 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        back = to
        while to < len(text) and back > at + 1 and to - back < 1000 and text[back - 1].isalpha():
            back -= 1  # lower case may depend on the rest of a word
        to = back if to - back < 1000 and back > at + 1 else to
        flat = np.frombuffer(text[at:to].lower().encode("utf-32-le"), np.uint32)
        letter = _letters()[flat]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after
        code = np.r_[held, np.where(letter, flat, 32)[keep].astype(np.uint64), np.full(int(to == len(text) and letter[-1]), 32, np.uint64)]
        yield _hashes(code, n) if len(code) >= n else np.zeros(0, np.uint64), int(letter.sum())
        held, after, at = code[max(0, len(code) - n + 1) :] if n > 1 else code[:0], bool(letter[-1]), to


@dataclass(frozen=True)
class LanguageModel:
    """A fitted filter. cells: masks; false_positive: the rate of each language's slice."""

    languages: tuple[str, ...]
    n: int
    hashes: int
    cells: np.ndarray
    false_positive: np.ndarray
    default: int

    def masks(self, grams: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.cells))
        step = (grams >> np.uint64(32)) | np.uint64(1)
        found = self.cells[grams % size]
        for i in range(1, self.hashes):
            found = found & self.cells[(grams + np.uint64(i) * step) % size]
        return found

    def _hits(self, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """n-grams of each text that each language holds, false positives among them."""
        masks = self.masks(grams)
        out = np.zeros((len(ends) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            hits = np.r_[0, np.cumsum((masks >> masks.dtype.type(k)) & masks.dtype.type(1), dtype=np.int64)]
            out[:, k] = hits[ends[1:]] - hits[ends[:-1]]
        return out

    def votes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(corrected count of each text and language, n-grams, letters of each text). A long text is read in pieces."""
        short = [t if len(t) <= PIECE else "" for t in texts]
        grams, sizes, letters = _grams(short, self.n)
        out = self._hits(grams, np.r_[0, np.cumsum(sizes)])
        for k, t in enumerate(texts):
            if len(t) > PIECE:
                for found, n in _pieces(t, self.n):
                    out[k] += self._hits(found, np.array([0, len(found)]))[0]
                    sizes[k] += len(found)
                    letters[k] += n
        rate = self.false_positive[None, :]
        return np.maximum(0, (out - rate * sizes[:, None]) / (1 - rate)), sizes, letters

    def _chosen(self, votes: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        best, total = votes.argmax(axis=1), votes.sum(axis=1)
        best = np.where(total > 0, best, self.default)
        score = np.where(total > 0, votes[np.arange(len(votes)), best] / np.maximum(total, 1e-12), 1 / max(1, len(self.languages)))
        found = [UNDETERMINED if not n else self.languages[b] for n, b in zip(letters, best, strict=True)]
        return found, np.where(letters > 0, np.clip(score, 0, 1), 0.0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        votes, _, letters = self.votes(texts)
        return self._chosen(votes, letters)

    def judged(self, texts: list[str], least: float, least_score: float) -> tuple[list[str], np.ndarray]:
        """(predicted language, whether to accept it) of each text.

        Some language must know the text: a vote above the false-positive level, a share of known n-grams not below
        `least` by more than two standard deviations of so few n-grams, and the language's part of all votes
        not below `least_score`. A text with letters and without a whole n-gram says nothing either way and passes.
        """
        votes, sizes, letters = self.votes(texts)
        found, score = self._chosen(votes, letters)
        share = votes.max(axis=1, initial=0.0) / np.maximum(1, sizes)
        low = least - 2 * np.sqrt(least * (1 - least) / np.maximum(1, sizes))
        return found, (letters > 0) & ((sizes == 0) | ((share > 0) & (share >= low) & (score >= least_score)))


def _gram_counts(n: int):
    def run(batches):
        for batch in batches:
            flat, at = raw_bytes(batch.column("text"))
            for i, j in slices(at, 2 << 20):
                languages = np.array(batch.column("lang")[i:j].to_pylist(), dtype=object)
                texts = [flat[at[r] : at[r + 1]].tobytes().decode() for r in range(i, j)]
                for name in sorted(set(languages)):
                    grams, count = np.unique(_grams([texts[r] for r in np.flatnonzero(languages == name)], n)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(count)], names=["lang", "gram", "n"])

    return run


def fit(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 500, n: int = 4, most_grams: int = 50_000, cells: int = 1 << 21, hashes: int = 3) -> LanguageModel:
    """A model of the labelled rows; rows without label or text are left out.

    About fit_rows rows of each language are read (bound on what is learnt from, by a hash of the id).
    A language's slice holds the n-grams that make 1/most_grams of its n-grams or more, so at
    most most_grams of them, unless another language holds them more than four times as often.
    Up to 64 languages.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if len(sizes) > 64:
        raise ValueError(f"{len(sizes)} languages; a mask holds 64")
    languages = tuple(sorted(sizes))
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table, false_positive = np.zeros(cells, kind), np.zeros(len(languages))
    if languages:
        share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, fit_rows / v)))])
        drawn = F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
        counts = rows.where(drawn < share[F.col("lang")]).select("text", "lang").mapInArrow(lean(_gram_counts(n)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        per = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(v)))]) if totals else None
        if totals:
            rate = counts.withColumn("rate", F.col("n") / per[F.col("lang")])
            top = rate.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate", "n")).alias("each"))
            kept = top.select("gram", "top", F.explode("each").alias("x")).where(f"x.rate * 4 >= top and x.rate >= {1 / most_grams} and x.n > 1").select("gram", F.col("x.lang").alias("lang"))
            found = kept.toPandas()  # at most most_grams rows a language
            for k, name in enumerate(languages):
                grams = found.gram[found.lang == name].to_numpy(np.int64).view(np.uint64)
                step = (grams >> np.uint64(32)) | np.uint64(1)
                for i in range(hashes):
                    table[(grams + np.uint64(i) * step) % np.uint64(cells)] |= kind(1 << k)
                false_positive[k] = ((table >> kind(k)) & kind(1)).mean() ** hashes
    default = max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k), default=0)
    return LanguageModel(languages, n, hashes, table, false_positive, default)


def _predictions(model: LanguageModel):
    def run(batches):
        for batch in batches:
            flat, at = raw_bytes(batch.column("text"))
            for i, j in slices(at, 1 << 19):
                texts = [flat[at[r] : at[r + 1]].tobytes().decode() for r in range(i, j)]
                found, score = model.predict(texts) if model.languages else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([batch.column("id")[i:j], pa.array(found, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return run


def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row, from the text alone.

    A text that is null or has no letter is `und` with score 0. A text none of whose n-grams is known
    gets the language with most labelled rows; equal votes go to the first language by name. The
    score is the language's share of all corrected votes. Null and repeated ids are kept; other
    columns are not read.
    """
    found = id_text(documents, id_col, text_col).mapInArrow(lean(_predictions(model)), "id long, lang_pred string, score double")
    return found.select(outer_id().alias(id_col), "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """One row in five, by the CRC-32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def bounds(clean: DataFrame, model: LanguageModel, part: float = 0.4, score_part: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, float]:
    """(least share of known n-grams, least score) for `accepted`, from rows that the model did not learn from.

    `part` of the median share, and `score_part` of the way from even votes to the median score. Clean
    rows lie close to the medians, so that even a table with much junk sets the same bounds.
    """
    if not model.languages:
        return 0.0, 0.0

    def run(batches):
        for batch in batches:
            flat, at = raw_bytes(batch.column("text"))
            for i, j in slices(at, 1 << 19):
                votes, sizes, letters = model.votes([flat[at[r] : at[r + 1]].tobytes().decode() for r in range(i, j)])
                some = sizes > 0
                share = votes.max(axis=1, initial=0.0) / np.maximum(1, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(share[some]), pa.array(model._chosen(votes, letters)[1][some])], names=["share", "score"])

    found = id_text(clean, id_col, text_col).mapInArrow(lean(run), "share double, score double").agg(F.percentile_approx("share", 0.5).alias("share"), F.percentile_approx("score", 0.5).alias("score")).first()
    even = 1 / len(model.languages)
    return part * (found["share"] or 0.0), even + score_part * max(0.0, (found["score"] or 0.0) - even)


def accepted(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0, languages: list[str] | None = None, least_score: float = 0.0, lang_col: str | None = None) -> DataFrame:
    """The documents whose text is in one of `languages` (by default all of the model's), with their columns.

    The predicted language and its score decide (LanguageModel.judged). Those without a letter go, and
    those that the corrected counts don't support: letter junk, encoded strings, unknown languages and scripts. lang_col, if given, gets the predicted language where it is null. A
    model without languages accepts nothing.
    """
    short_batches(documents.sparkSession)
    spark_schema = documents.schema
    at = spark_schema.names.index(text_col)
    label = spark_schema.names.index(lang_col) if lang_col else None
    wanted = set(model.languages if languages is None else languages)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            sizes = np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))]
            for i, j in slices(sizes, 1 << 19):
                part = batch.slice(i, j - i)
                own = [t or "" for t in texts[i:j].to_pylist()]
                if not model.languages:
                    continue
                found, keep = model.judged(own, least, least_score)
                keep &= np.array([f in wanted for f in found], bool)
                if label is not None:
                    given = pa.compute.coalesce(part.column(label), pa.array(found, part.schema.types[label]))
                    part = part.set_column(label, part.schema.names[label], given)
                yield part.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(lean(run), spark_schema)
