"""Subject areas of documents: seeded, anchored non-negative factors of the document-term matrix."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.llm.normal import plain
from rollmill.llm.pairs import FUNCTION_WORDS
from rollmill.plans.store import discard, written

#: Hash slots of terms.
SLOTS = 1 << 21
#: A term takes part if, in some language, at least this share of its documents has it (and at least MIN_DOCUMENTS of them): a rare
#: language has its own terms. So at most (terms of a document) / LEAST_SHARE terms of a language are collected.
LEAST_SHARE, MIN_DOCUMENTS = 0.002, 3
#: Terms in at least this share of a language's documents are generic, and belong to the background only, unless labelled documents of
#: some subject have them in excess: LIFT times as often as all documents.
GENERIC_SHARE, LIFT = 0.2, 1.5
#: Labelled documents that seed the factors, at most (the first by hash of their id).
MAX_LABELLED = 200_000
#: Alternating updates; inner steps for the document side.
ROUNDS, INNER = 3, 12
#: How firmly the background components are held to their seeds, so that they don't turn into half of some subject.
HOLD = 0.8
#: A run of fewer words is a mark (a role, a number, a verdict), no sentence.
SENTENCE_WORDS = 3
#: A sentence treats the subject to which most of its terms belong, if that is more than this share of them.
TERM_SHARE = 0.08

_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"(?<=[.!?…])[\s\"”»)\]']+|\n+")
_BLOCKS = tuple(FUNCTION_WORDS)
_BLOCK_OF: dict[str, list[int]] = {}
for _b, _l in enumerate(_BLOCKS):
    for _w in set(plain(FUNCTION_WORDS[_l]).split()):
        _BLOCK_OF.setdefault(_w, []).append(_b)
N_BLOCKS = len(_BLOCKS) + 1  # the last: no language recognised


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text to term slots by sentence: id, block (language by function words), terms, terms of each sentence."""
    slot_of: dict[str, int] = {}
    for batch in batches:
        blocks, terms, lengths, n_terms, n_sentences = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            votes = [0] * N_BLOCKS
            before, sentences = len(terms), 0
            for part in _BREAK.split(plain(text)):
                found = _WORD.findall(part)
                if len(found) < SENTENCE_WORDS:
                    continue
                start = len(terms)
                for w in found:
                    b = _BLOCK_OF.get(w)
                    if b is not None:
                        for k in b:
                            votes[k] += 1
                    elif len(w) > 1:
                        s = slot_of.get(w)
                        if s is None:
                            if len(slot_of) > 500_000:
                                slot_of.clear()
                            s = slot_of[w] = zlib.crc32(w.encode()) % SLOTS
                        terms.append(s)
                lengths.append(len(terms) - start)
                sentences += 1
            blocks.append(max(range(N_BLOCKS), key=votes.__getitem__) if any(votes) else N_BLOCKS - 1)
            n_terms.append(len(terms) - before)
            n_sentences.append(sentences)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(blocks, pa.int32()), _ragged(np.array(terms, np.int32), n_terms), _ragged(np.array(lengths, np.int32), n_sentences)], names=["id", "block", "terms", "lengths"]
        )


def _ragged(values: np.ndarray, sizes: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row that each belongs to."""
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.asarray(column.flatten()), np.repeat(np.arange(len(sizes)), sizes)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each (block, slot); slot -1 counts the documents of the block."""
    for batch in batches:
        blocks = np.asarray(batch.column(0)).astype(np.int64)
        terms, row = _flat(batch.column(1))
        pair = np.unique(row * np.int64(SLOTS) + terms)
        cell, c = np.unique(blocks[pair // SLOTS] * np.int64(SLOTS) + pair % SLOTS, return_counts=True)
        every, n = np.unique(blocks, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([cell // SLOTS, every]).astype(np.int32)), pa.array(np.concatenate([cell % SLOTS, np.full(len(every), -1)]).astype(np.int32)), pa.array(np.concatenate([c, n]).astype(np.int64))],
            names=["block", "slot", "c"],
        )


class Terms:
    """The terms that take part: slot to column, inverse document frequency, document counts by block."""

    def __init__(self, slots: np.ndarray, by_block: np.ndarray, documents: np.ndarray):
        self.column = np.full(SLOTS, -1, np.int32)
        self.column[slots] = np.arange(len(slots), dtype=np.int32)
        self.by_block, self.documents = by_block, documents
        self.idf = np.log(max(1, documents.sum()) / np.maximum(1, by_block.sum(0))) + 1e-3

    @property
    def n(self) -> int:
        return self.by_block.shape[1]

    def frequent(self) -> np.ndarray:
        return self.by_block >= GENERIC_SHARE * np.maximum(1, self.documents)[:, None]


def _terms(tokens: DataFrame) -> Terms:
    """Counted over all documents; the terms that take part come to the driver (see LEAST_SHARE)."""
    counts = tokens.select("block", "terms").mapInArrow(_count, "block int, slot int, c bigint")
    per_block = [F.sum(F.when(F.col("block") == b, F.col("c")).otherwise(0)).alias(f"b{b}") for b in range(N_BLOCKS)]
    by_slot = written(counts.groupBy("slot").agg(*per_block), "terms")
    found = [list(r)[1:] for r in by_slot.where(F.col("slot") == -1).collect()]
    documents = np.array(found or [[0] * N_BLOCKS], np.int64)[0]
    often = F.lit(False)
    for b in range(N_BLOCKS):
        often = often | (F.col(f"b{b}") >= max(MIN_DOCUMENTS, LEAST_SHARE * int(documents[b])))
    rows = by_slot.where((F.col("slot") >= 0) & often).orderBy("slot").collect()
    discard(by_slot)
    return Terms(np.array([r.slot for r in rows], np.int64), np.array([list(r)[1:] for r in rows], np.int64).reshape(-1, N_BLOCKS).T, documents)


def _matrix(broadcast):
    """Rows of the document-term matrix: weights sqrt(count) * idf, scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Terms = broadcast.value
        for batch in batches:
            terms, row = _flat(batch.column(2))
            column = own.column[terms].astype(np.int64)
            keep = column >= 0
            cell, count = np.unique(row[keep] * np.int64(own.n or 1) + column[keep], return_counts=True)
            row, column = cell // (own.n or 1), cell % (own.n or 1)
            value = np.sqrt(count) * own.idf[column]
            norm = np.sqrt(np.bincount(row, weights=value * value, minlength=batch.num_rows))
            value = value / np.maximum(norm[row], 1e-12)
            sizes = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ragged(column.astype(np.int32), sizes), _ragged(value.astype(np.float32), sizes)], names=["id", "block", "columns", "values"])

    return run


def _sums(broadcast, n_subjects: int):
    """One pass over the matrix: what the factor side needs, summed over a partition, as (cell, value) rows.

    Without factors it sums the labelled rows by subject (the seeds) and all rows; with factors it solves the document side and sums
    the products of both sides. Cells are numbered (block, component, term); components beyond the terms hold the component products.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, n_terms = broadcast.value
        k = n_subjects + 2
        wide = n_terms + k
        total = np.zeros((N_BLOCKS, k, wide))
        for batch in batches:
            blocks = np.asarray(batch.column(0))
            columns, row = _flat(batch.column(1))
            values = np.asarray(batch.column(2).flatten(), dtype=np.float64)
            labels = np.asarray(batch.column(3).fill_null(0), dtype=np.int64)
            marked = (labels[:, None] >> np.arange(n_subjects)) & 1
            for b in np.unique(blocks):
                mine = np.flatnonzero(blocks == b)
                place = np.full(len(blocks), -1)
                place[mine] = np.arange(len(mine))
                at = place[row] >= 0
                r, c, v = place[row[at]], columns[at], values[at]
                own = marked[mine].astype(float)
                has = own.sum(1) > 0
                if factors is None:
                    left = np.zeros((len(mine), k))
                    left[has, :n_subjects] = own[has] / own[has].sum(1, keepdims=True)
                    left[:, n_subjects] = 1.0
                else:
                    mask = np.ones((len(mine), k))
                    mask[has, :n_subjects] = np.where(own[has] > 0, 1.0, 0.1)  # labels anchor, but may miss subjects
                    left = _solve(factors[b], r, c, v, len(mine), mask)
                for j in range(k):
                    if left[:, j].any():
                        total[b, j, :n_terms] += np.bincount(c, weights=v * left[r, j], minlength=n_terms)
                if factors is None:
                    total[b, :, n_terms] += left.sum(0)
                else:
                    total[b, :, n_terms:] += left.T @ left
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "value"])

    return run


def _gather(matrix: DataFrame, factors: np.ndarray | None, n_terms: int, n_subjects: int) -> np.ndarray:
    """The sums of a pass; a bounded number of cells (blocks x components x terms) comes to the driver."""
    state = matrix.sparkSession.sparkContext.broadcast((factors, n_terms))
    rows = matrix.select("block", "columns", "values", "labels").mapInArrow(_sums(state, n_subjects), "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(N_BLOCKS * (n_subjects + 2) * (n_terms + n_subjects + 2))
    out[rows["cell"].to_numpy(np.int64)] = rows["value"].to_numpy()
    return out.reshape(N_BLOCKS, n_subjects + 2, n_terms + n_subjects + 2)


def _seed(sums: np.ndarray, terms: Terms, n_subjects: int, about: np.ndarray) -> np.ndarray:
    """First factors: by block a component for each subject, one for generic terms and one for what belongs to no subject."""
    h = np.zeros((N_BLOCKS, n_subjects + 2, terms.n))
    frequent = terms.frequent()
    for b in range(N_BLOCKS):
        n = max(1, terms.documents[b])
        base = sums[b, n_subjects, : terms.n] / n
        labelled = sums[b, :n_subjects, terms.n]
        rate = sums[b, :n_subjects, : terms.n] / np.maximum(labelled, 1e-9)[:, None]
        generic = frequent[b] & ~(rate > LIFT * base).any(0)
        content = ~generic
        lift = np.maximum(0, rate - LIFT * base) * content
        lift = np.where((labelled > 0)[:, None], lift, about * content * base)
        lift /= np.maximum(lift.sum(1, keepdims=True), 1e-12)
        spread = base * content / max(base.sum(), 1e-12)
        h[b, :n_subjects] = np.where(lift.sum(1, keepdims=True) > 0, lift + 0.02 * spread, 0)
        h[b, n_subjects] = np.where(generic, terms.by_block[b] / n, 0)
        h[b, n_subjects + 1] = base * content
        h[b] /= np.maximum(h[b].sum(1, keepdims=True), 1e-12)
    return h


def fit(matrix: DataFrame, terms: Terms, n_subjects: int, about: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Factors (blocks x components x terms) from seeded non-negative alternating updates; the last block, of no language, has those of all."""
    if not terms.n:
        return np.zeros((N_BLOCKS, n_subjects + 2, 0))
    h = _seed(_gather(matrix, None, terms.n, n_subjects), terms, n_subjects, about)
    first, mass = h[:, n_subjects:].copy(), np.ones(h.shape[:2])
    for _ in range(rounds):
        sums = _gather(matrix, h, terms.n, n_subjects)
        for b in range(N_BLOCKS):
            with_terms, products = sums[b, :, : terms.n], sums[b, :, terms.n :]
            for _ in range(3):
                h[b] *= with_terms / np.maximum(products @ h[b], 1e-12)
            scale = h[b].sum(1)
            mass[b] = scale * np.sqrt(np.maximum(np.diag(products), 0))
            h[b] /= np.maximum(scale, 1e-12)[:, None]
            h[b, n_subjects:] += HOLD * (first[b] - h[b, n_subjects:])
    joint = (h * mass[:, :, None]).sum(0)
    h[-1] = joint / np.maximum(joint.sum(1, keepdims=True), 1e-12)
    return h


def _solve(h: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, mask: np.ndarray | None = None) -> np.ndarray:
    """The document side: non-negative weights of the components for ``n`` sparse rows, by multiplicative updates with ``h`` fixed."""
    gram = h @ h.T
    along = np.stack([np.bincount(row, weights=value * part[column], minlength=n) for part in h], 1)
    left = along / np.maximum(np.diag(gram), 1e-12) + 1e-12
    if mask is not None:
        left = left * mask
    for _ in range(INNER):
        left *= along / np.maximum(left @ gram, 1e-12)
    return left


def _shares(broadcast, names: list[str], id: str):
    """Every document is solved on the factors of its language; its mixture shares out its terms, and those of a sentence decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, terms = broadcast.value
        for batch in batches:
            block_of = np.asarray(batch.column(1))
            lengths, doc = _flat(batch.column(3))
            found, _ = _flat(batch.column(2))
            sentence = np.repeat(np.arange(len(lengths)), lengths)
            column = terms.column[found].astype(np.int64)
            keep = column >= 0
            cell = np.unique(sentence[keep] * np.int64(max(1, terms.n)) + column[keep])
            sentence, column = cell // max(1, terms.n), cell % max(1, terms.n)
            belongs = np.zeros((len(lengths), len(names)))
            for b in np.unique(block_of):
                at = np.flatnonzero(block_of[doc[sentence]] == b)
                if not len(at):
                    continue
                own, row = np.unique(doc[sentence[at]], return_inverse=True)
                mixture = _solve(factors[b], row, column[at], terms.idf[column[at]], len(own))
                part = mixture[row] * factors[b][:, column[at]].T
                part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
                for k in range(len(names)):
                    belongs[:, k] += np.bincount(sentence[at], weights=part[:, k], minlength=len(lengths))
            belongs /= np.maximum(1, np.bincount(sentence, minlength=len(lengths)))[:, None]
            best = belongs.argmax(1) if len(lengths) else np.zeros(0, np.int64)
            best = np.where(belongs[np.arange(len(lengths)), best] > TERM_SHARE, best, -1)
            treats = best >= 0
            number = np.bincount(doc, minlength=batch.num_rows)
            cell, count = np.unique(doc[treats] * np.int64(len(names)) + best[treats], return_counts=True)
            d, s = cell // len(names), cell % len(names)
            subject = pa.array(np.array(names, object)[s].tolist(), pa.string())
            share = pa.array(count / np.maximum(1, number[d]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(d)), subject, pa.array(count.astype(np.int32)), pa.array(number[d].astype(np.int32)), share],
                names=[id, "subject", "n_sentences", "of_sentences", "share"],
            )

    return run


def subject_shares(documents: DataFrame, id: str, text: str, subjects: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(``id``, ``subject``, ``n_sentences``, ``of_sentences``, ``share``): the subjects that a document's sentences treat, with their share.

    ``subjects`` has ``subject`` and ``about``; ``labels`` has ``id`` and ``subject`` (any case and spacing; unknown subjects and documents
    are ignored, repeated rows count once). Documents of null id or text, without a sentence or without evidence for any subject give no
    row. Repeated documents count like any other; without labels only the words of ``about`` seed the factors; empty tables give an empty
    result; other columns aren't read. Texts are read whole, and all counts and sums cover all documents.

    1. Texts become term slots by sentence. Terms by document frequency make the columns; function words and generic terms don't count.
    2. The document-term matrix is factored, by language, with seeded multiplicative updates (Frobenius norm): a component for each
       subject, seeded with the terms that labelled documents of the subject have in excess and anchored by their labels, and two for what
       belongs to no subject. A round is one pass over the matrix: every task solves its documents and adds up what the factor side needs;
       sums of blocks x components x terms come to the driver, whatever the number of documents.
    3. The mixtures are read off the document side: every document is solved on the factors of its language, and its weights on the
       components share out its terms among them (weight times factor). A sentence treats the subject that most of its terms belong to,
       if that is more than ``TERM_SHARE`` of them; so a lone subject word in a document about something else counts for little.
    """
    spark = documents.sparkSession
    named = subjects.where(F.col("subject").isNotNull()).select("subject", "about").distinct().orderBy("subject").collect()  # a fixed, small table
    names = [r.subject for r in named]
    if not names or len(names) > 62:
        raise ValueError("1 to 62 subjects are needed")
    type_of_id = documents.schema[id].dataType.simpleString()
    rows = documents.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    tokens = written(rows.mapInArrow(_tokenise, f"id {type_of_id}, block int, terms array<int>, lengths array<int>"), "tokens")
    terms = _terms(tokens)

    key = F.lower(F.trim("subject"))
    numbers = spark.createDataFrame([(n.strip().lower(), 1 << k) for k, n in enumerate(names)], "name string, bit bigint")
    known = labels.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), key.alias("name")).join(F.broadcast(numbers), "name").groupBy("id").agg(F.bit_or("bit").alias("labels"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    shared = spark.sparkContext.broadcast(terms)
    matrix = tokens.select("id", "block", "terms").mapInArrow(_matrix(shared), f"id {type_of_id}, block int, columns array<int>, values array<float>")
    matrix = written(matrix.join(F.broadcast(known), "id", "left").drop("id"), "matrix")
    about = np.zeros((len(names), terms.n))
    for k, r in enumerate(named):
        for w in _WORD.findall(plain(f"{r.subject} {r.about or ''}")):
            c = terms.column[zlib.crc32(w.encode()) % SLOTS]
            if c >= 0 and w not in _BLOCK_OF:
                about[k, c] = 1.0
    factors = fit(matrix, terms, len(names), about, rounds)
    discard(matrix)
    model = spark.sparkContext.broadcast((factors, terms))
    return tokens.select("id", "block", "terms", "lengths").mapInArrow(_shares(model, names, id), f"`{id}` {type_of_id}, subject string, n_sentences int, of_sentences int, share double")
