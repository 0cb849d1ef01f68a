"""Evaluation texts leaking into training text, by latent semantic retrieval.

A randomised singular value decomposition of the corpus's TF-IDF passages (terms hashed to a fixed number of buckets,
statistics and decomposition over all documents) gives a latent space. Documents are cut into passages of two widths there:

* *blocks* of ``BLOCK`` words, one after the other, are held against the block at every word of every item. A cosine
  of ``sharp`` or more makes a candidate.
* *wide* passages of ``WIDE`` blocks, one at every block, are held against those of the items. Reworded text differs in
  single words but keeps its direction over a wide passage: a cosine of ``broad`` or more makes a candidate, if the
  document holds enough of the item's rarest words.

Item passages lie in cells around centroids, and a document's passage is held only against cells near it. For blocks the
cells that can't hold a partner are left out by the triangle inequality, so none is missed; for wide passages the nearest
``PROBES`` cells are searched.

Every candidate, a region of a document and an item, is then checked on the words themselves: the longest common run,
the longest common subsequence, and how many of the item's rarest words, its answer, stand there. Any ``run_words`` words
in a row hold a whole block, and the same words always have the same vector, so a verbatim run is always among the
candidates; whether a reworded passage is depends on the space.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scratch

#: Hash buckets for terms, dimensions kept, further dimensions of the sketch.
BUCKETS, DIMENSIONS, OVERSAMPLING = 1 << 15, 32, 8
#: Words of a block; blocks of a wide passage.
BLOCK, WIDE = 5, 3
#: Cosines from which a block and a wide passage are candidates.
SHARP, BROAD = 0.999, 0.7
#: Cells searched for a wide passage.
PROBES = 8
#: Item words held at once; more items take more passes over the corpus. Bounds what is broadcast: about 100 MB.
ITEM_WORDS = 400_000
#: Longer items are searched in segments of so many words, each beginning so many words before the last one's end.
SEGMENT, SEGMENT_OVERLAP = 2_000, 200
#: Words of documents handled at once in a worker; a longer document is handled by itself.
GROUP_WORDS = 400_000
SEED = 7
_TERMS_PER_PART = 1024


def word_list(text: str | None) -> list[str]:
    """Words of the NFKC form without soft hyphens and zero-width spaces."""
    return [w for w in _split([text])[0].as_py() if w]


def _split(texts: list) -> pa.ListArray:
    """Lower-case words of each text; the first and last of a list may be empty."""
    normal = [(t if t.isascii() else unicodedata.normalize("NFKC", t).replace("\xad", "").replace("​", "")).lower() for t in (t or "" for t in texts)]
    normal = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in normal]  # lone surrogates
    return pc.split_pattern_regex(pa.array(normal, pa.large_string()), r"[^\p{L}\p{N}]+")


def _hash_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin and end."""
    lists = _split(texts)
    coded = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in coded.dictionary.to_pylist()] or [0], np.uint64)
    flat = hashes[coded.indices.to_numpy(zero_copy_only=False)]
    word = flat != 0
    ends = np.concatenate(([0], np.cumsum(word)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return flat[word], ends.astype(np.int32)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, ends = _hash_words(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["doc", "words"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, words and ends of runs of documents with words, of about ``GROUP_WORDS`` words each."""
    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
        some = np.flatnonzero(np.diff(ends))
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends[some + 1], ends[some[at]] + GROUP_WORDS, "right")))
            low, high = ends[some[at]], ends[some[to - 1] + 1]
            yield batch.column(0).take(pa.array(some[at:to])), flat[low:high], np.concatenate((ends[some[at:to]], [high])) - low
            at = to


def _blocks(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each block of ``size`` words; a text's last block may be shorter. Texts have words."""
    counts = -(-np.diff(ends) // size)
    owner = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return ends[owner] + number * size, owner


def _terms(flat: np.ndarray) -> np.ndarray:
    return (flat & np.uint64(BUCKETS - 1)).astype(np.uint16)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: number of passages that hold each bucket's terms, and at -1 of all."""
    held, total = np.zeros(BUCKETS, np.int64), 0
    for _, flat, ends in _groups(batches):
        starts, _ = _blocks(ends, BLOCK * WIDE)
        passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
        held += np.bincount(pd.unique(passage * BUCKETS + _terms(flat)) % BUCKETS, minlength=BUCKETS)
        total += len(starts)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(held[at], total))], ["term", "n"])


def _sketcher(idf, basis):
    """mapInArrow: this task's part of A' A B for the TF-IDF passages A and a basis B, in parts of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, b = idf.value, basis.value
        weighted = b * weight[:, None]
        z = np.zeros(b.shape, np.float64)
        for _, flat, ends in _groups(batches):
            every, starts = _terms(flat), _blocks(ends, BLOCK * WIDE)[0]
            edges = np.append(starts, len(flat))
            for i in range(0, len(starts), 2_048):  # so few that the vectors stay in the cache
                begin = starts[i : i + 2_048] - starts[i]
                terms = every[starts[i] : edges[min(i + 2_048, len(starts))]]
                passage = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(terms))))
                y = np.add.reduceat(weighted[terms], begin, axis=0) / np.add.reduceat(weight[terms] ** 2, begin)[:, None]
                order = np.argsort(terms, kind="stable")
                ordered = terms[order]
                at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                z[ordered[at]] += np.add.reduceat(y[passage[order]], at, axis=0)
        z *= weight[:, None]
        for k in range(0, BUCKETS, _TERMS_PER_PART):
            part = z[k : k + _TERMS_PER_PART].astype(np.float32)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: sum of the parts of each block; holds one array per block, however many parts come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(part, np.float32).astype(np.float64)
            sums[k] = sums[k] + x if k in sums else x
    for k, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["block", "part"])


class LatentSpace:
    """TF-IDF weights and right singular vectors of all passages of a corpus; of fixed size whatever the corpus."""

    def __init__(self, idf: np.ndarray, vectors: np.ndarray):
        self.idf, self.vectors = idf, vectors
        # No term may have a zero vector, or equal passages of such terms would have no cosine.
        floor = np.random.default_rng(SEED).standard_normal(vectors.shape) * 1e-6 * np.abs(vectors).max(initial=1e-6)
        self.weighted = (idf[:, None] * (vectors + floor)).astype(np.float32)

    @classmethod
    def fit(cls, words: DataFrame) -> LatentSpace:
        """Randomised SVD: a Gaussian sketch of A'A, the right singular vectors by Nyström's formula; two passes over all
        passages, of which one counts terms."""
        sc = words.sparkSession.sparkContext
        held, total = np.zeros(BUCKETS), 0
        for r in words.mapInArrow(_counter, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
            if r.term < 0:
                total = r.n
            else:
                held[r.term] = r.n
        idf = (np.log((1 + total) / (1 + held)) + 1).astype(np.float32)
        weights = sc.broadcast(idf)
        width = DIMENSIONS + OVERSAMPLING

        sketch = np.random.default_rng(SEED).standard_normal((BUCKETS, width))
        sent = sc.broadcast(sketch.astype(np.float32))
        schema = "block int, part binary"
        parts = words.mapInArrow(_sketcher(weights, sent), schema).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
        parts = parts.repartition("block", "salt").select("block", "part").mapInArrow(_add, schema).repartition("block").mapInArrow(_add, schema)
        y = np.zeros(sketch.shape)
        for r in parts.collect():  # BUCKETS / 1024 rows of fixed size
            x = np.frombuffer(r.part, np.float32).reshape(-1, width)
            y[r.block : r.block + len(x)] = x
        # A'A is about Y (S'Y)^-1 Y', whose eigenvectors are the left singular vectors of Y (S'Y)^-1/2.
        y += 1e-7 * np.abs(y).max(initial=1e-7) * sketch
        values, turn = np.linalg.eigh((sketch.T @ y + y.T @ sketch) / 2)
        values = np.maximum(values, 1e-12 * np.abs(values).max(initial=1e-12))
        vectors = np.linalg.svd(y @ (turn / np.sqrt(values)), full_matrices=False)[0]
        return cls(idf, vectors[:, :DIMENSIONS].astype(np.float32))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.float32(1e-30))[:, None]


class _Cells:
    """Unit vectors grouped around centroids."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        k = max(1, min(n, int(4 * n**0.5)))
        rng = np.random.default_rng(SEED)
        self.centroids = vectors[np.sort(rng.choice(n, k, replace=False))] if n else vectors
        for _ in range(4 if n else 0):
            near = self._nearest(vectors)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, vectors)
            self.centroids = np.where((np.bincount(near, minlength=k) > 0)[:, None], _unit(sums), self.centroids)
        near = self._nearest(vectors) if n else np.zeros(0, np.int64)
        self.members = np.argsort(near, kind="stable")
        self.edges = np.searchsorted(near[self.members], np.arange(k + 1))
        self.vectors = vectors[self.members]
        cosine = np.einsum("ij,ij->i", vectors, self.centroids[near]) if n else np.zeros(0)
        self.radius = np.zeros(k)
        np.maximum.at(self.radius, near, np.arccos(np.clip(cosine, -1, 1)))

    def _nearest(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(vectors[i : i + 16_384] @ self.centroids.T, axis=1) for i in range(0, len(vectors), 16_384)])

    def search(self, x: np.ndarray, least: float, probes: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of x, vector, cosine) of the pairs at cosine ``least`` or more: all of them, or those in the ``probes``
        cells nearest to each row."""
        if not len(self.vectors):
            return
        reach = np.cos(np.minimum(np.pi, self.radius + np.arccos(least) + 1e-3)).astype(np.float32)
        for i in range(0, len(x), 16_384):
            part = x[i : i + 16_384]
            to = self.centroids @ part.T
            may = to >= reach[:, None]
            if probes and probes < len(to):
                may &= to >= np.partition(to, -probes, axis=0)[-probes]
            cell_of, row_of = np.nonzero(may)
            cuts = np.searchsorted(cell_of, np.arange(len(self.centroids) + 1))
            for c in np.flatnonzero(np.diff(cuts)):
                rows = row_of[cuts[c] : cuts[c + 1]]
                cosine = part[rows] @ self.vectors[self.edges[c] : self.edges[c + 1]].T
                p, q = np.nonzero(cosine >= least)
                if len(p):
                    yield i + rows[p], self.members[self.edges[c] + q], cosine[p, q]


class _Items:
    """One block of items (or segments of them) as arrays: their words, passages in cells, places of words as bits."""

    def __init__(self, ids: list[int], texts: list[str], space: LatentSpace, answer_words: int):
        flat, ends = _hash_words(texts)
        parts = [(n, a, min(a + SEGMENT, high)) for n, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) for a in range(low, max(low + 1, high - SEGMENT_OVERLAP), SEGMENT - SEGMENT_OVERLAP) if high - low >= BLOCK]
        self.ids = np.array([ids[n] for n, _, _ in parts], np.int64)
        self.n = np.array([b - a for _, a, b in parts], np.int64)
        self.words = np.concatenate([flat[a:b] for _, a, b in parts]) if parts else flat[:0]
        first = np.concatenate(([0], np.cumsum(self.n)))[:-1]
        item = np.arange(len(parts))

        def passages(width: int, step: int) -> tuple[_Cells, np.ndarray, np.ndarray]:
            """Cells of the passages, and each one's item and first word; a shorter item is one passage."""
            at = [np.unique(np.append(np.arange(0, max(1, n - width + 1), step), max(0, n - width))) for n in self.n.tolist()]
            owner, at = np.repeat(item, [len(x) for x in at]), np.concatenate(at) if at else np.zeros(0, np.int64)
            vectors = np.stack([space.weighted[_terms(self.words[first[o] + a : min(first[o] + a + width, first[o] + self.n[o])])].sum(axis=0) for o, a in zip(owner, at)]) if len(at) else np.zeros((0, DIMENSIONS), np.float32)
            return _Cells(_unit(vectors)), owner, at

        self.sharp, self.broad = passages(BLOCK, 1), passages(BLOCK * WIDE, BLOCK)
        # Places of each item's words as bits, 64 a limb.
        self.limbs = -(-self.n // 64)
        owner = np.repeat(item, self.n)
        place = np.arange(len(self.words)) - first[owner]
        key = self.key(owner, self.words)
        self.keys, which = np.unique(key, return_inverse=True)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys & np.uint64(len(self.maybe) - 1)] = True
        key_item = np.zeros(len(self.keys), np.int64)
        key_item[which] = owner
        self.limb_at = np.concatenate(([0], np.cumsum(self.limbs[key_item]))).astype(np.int64)
        self.bits = np.zeros(self.limb_at[-1] + 1, np.uint64)
        np.bitwise_or.at(self.bits, self.limb_at[which] + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
        # The rarest words of each item.
        self.rare = np.zeros((len(parts), answer_words), np.uint64)
        self.rares = np.zeros(len(parts), np.int64)
        for n, (a, k) in enumerate(zip(first.tolist(), self.n.tolist())):
            own = np.unique(self.words[a : a + k])
            own = own[np.argsort(-space.idf[_terms(own)], kind="stable")][:answer_words]
            self.rare[n, : len(own)], self.rares[n] = own, len(own)
        pairs = np.flatnonzero(np.arange(answer_words) < self.rares[:, None])
        by = np.argsort(self.rare.ravel()[pairs], kind="stable")
        self.rare_words, begins = np.unique(self.rare.ravel()[pairs][by], return_index=True)
        self.rare_terms = np.zeros(BUCKETS, bool)
        self.rare_terms[_terms(self.rare_words)] = True
        self.rare_items, self.rare_edges = pairs[by] // answer_words, np.append(begins, len(pairs))

    @staticmethod
    def key(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = (words ^ (item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(31))


def _answered(items: _Items, flat: np.ndarray, ends: np.ndarray, share: float) -> np.ndarray:
    """Sorted numbers text * items + item of the texts that hold so large a share of the item's rarest words anywhere."""
    n = len(items.ids)
    if not n:
        return np.zeros(0, np.int64)
    here = np.flatnonzero(items.rare_terms[_terms(flat)])
    at = np.minimum(np.searchsorted(items.rare_words, flat[here]), len(items.rare_words) - 1)
    same = items.rare_words[at] == flat[here]
    here, at = here[same], at[same]
    text = np.searchsorted(ends, here, "right") - 1
    seen = np.unique(text * len(items.rare_words) + at)
    text, word = seen // len(items.rare_words), seen % len(items.rare_words)
    times = items.rare_edges[word + 1] - items.rare_edges[word]
    item = items.rare_items[np.repeat(items.rare_edges[word], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    pair, found = np.unique(np.repeat(text, times) * n + item, return_counts=True)
    return pair[found >= share * items.rares[pair % n]]


def _places(items: _Items, flat: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, limbs: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each region, and of each word the bits of the places where its item has it."""
    at = low[:, None] + np.arange(int((high - low).max()))
    valid = at < high[:, None]
    words = flat[np.minimum(at, len(flat) - 1)]
    key = items.key(item[:, None], words)
    row, col = np.nonzero(valid & items.maybe[key & np.uint64(len(items.maybe) - 1)])
    key = key[row, col]
    where = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
    same = items.keys[where] == key
    bits = np.zeros((*at.shape, limbs), np.uint64)
    bits[row[same], col[same]] = items.bits[items.limb_at[where[same]][:, None] + np.arange(limbs)]
    return np.where(at < high[:, None], words, 0), bits


def _longest_runs(bits: np.ndarray) -> np.ndarray:
    """Longest common run of each region and its item."""
    best, live, now, k = np.zeros(len(bits), np.int64), np.arange(len(bits)), bits, 0
    while True:
        some = now.any(axis=(1, 2))
        live, now, bits = live[some], now[some], bits[some]
        if not len(live):
            return best
        k += 1
        best[live] = k
        moved = now << np.uint64(1)
        moved[:, :, 1:] |= now[:, :, :-1] >> np.uint64(63)
        now = np.zeros_like(now)
        now[:, 1:] = bits[:, 1:] & moved[:, :-1]


def _common_subsequences(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each region and its item of ``n`` words, by bit vectors (Hyyrö)."""
    limbs = bits.shape[2]
    v = np.full((limbs, len(bits)), np.uint64(2**64 - 1))
    steps = np.ascontiguousarray(bits.transpose(1, 2, 0))
    for m in steps:
        carry = np.zeros(len(bits), np.uint64)
        for k in range(limbs):
            u = v[k] & m[k]
            total = v[k] + u
            over = total < u
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            v[k] = total | (v[k] & ~u)
    left = np.clip(n[None, :] - 64 * np.arange(limbs)[:, None], 0, 64)
    full = np.where(left == 64, np.uint64(2**64 - 1), (np.uint64(1) << left.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    return n - np.bitwise_count(v & full).sum(axis=0, dtype=np.int64)


def _candidates(items: _Items, space: LatentSpace, flat: np.ndarray, ends: np.ndarray, sharp: float, broad: float, answer: float, probes: int | None) -> tuple[np.ndarray, ...]:
    """(text, item, cell of offsets, greatest cosine) of all regions with a passage near one of the item."""
    starts, owner = _blocks(ends, BLOCK)
    sums = np.concatenate([np.add.reduceat(space.weighted[_terms(flat[starts[i] : starts[j] if j < len(starts) else len(flat)])], starts[i:j] - starts[i], axis=0) for i in range(0, len(starts), 8_192) for j in [min(i + 8_192, len(starts))]])
    whole = np.flatnonzero(np.append(starts[1:], len(flat)) - starts == BLOCK)
    count = np.bincount(owner, minlength=len(ends) - 1)
    number = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.flatnonzero(number <= np.maximum(count - WIDE, 0)[owner])
    answered = _answered(items, flat, ends, answer)
    # A reworded passage must hold the answer, so texts without any item's answer aren't searched for one.
    told = np.zeros(len(ends) - 1, bool)
    told[answered // max(1, len(items.ids))] = True
    begin = begin[told[owner[begin]]]
    padded = np.concatenate((sums, np.zeros((WIDE, sums.shape[1]), np.float32)))
    wide = sum(np.where((k < count[owner[begin]])[:, None], padded[begin + k], 0) for k in range(WIDE))
    found = []
    for rows, vectors, (cells, of, at), least, near in ((whole, sums[whole], items.sharp, sharp, None), (begin, wide, items.broad, broad, probes)):
        for row, member, cosine in cells.search(_unit(vectors), least, near):
            text, item = owner[rows[row]], of[member]
            if near is not None or least == broad:
                pair = text * len(items.ids) + item
                known = np.minimum(np.searchsorted(answered, pair), max(0, len(answered) - 1))
                keep = np.flatnonzero(answered[known] == pair) if len(answered) else np.zeros(0, np.int64)
                row, member, cosine, text, item = row[keep], member[keep], cosine[keep], text[keep], item[keep]
            offset = starts[rows[row]] - ends[text] - at[member]
            found.append(np.stack([text, item, offset // np.maximum(8, items.n[item] // 2), (cosine * 1e6).astype(np.int64)]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    text, item, cell, cosine = np.concatenate(found, axis=1)
    order = np.lexsort((cell, item, text))
    text, item, cell, cosine = text[order], item[order], cell[order], cosine[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1]))) if len(text) else np.zeros(0, np.int64)
    return text[first], item[first], cell[first], np.maximum.reduceat(cosine, first) if len(first) else cosine


def _searcher(space, sent, sharp: float, broad: float, run_words: int, common: float, answer: float, probes: int | None):
    """mapInArrow: the pairs of each group of documents with the items of a block that pass the checks."""
    names = ["doc", "item", "run", "cosine", "common", "answer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, items = cloudpickle.loads(space.value), cloudpickle.loads(sent.value)
        for docs, flat, ends in _groups(batches):
            text, item, cell, cosine = _candidates(items, latent, flat, ends, sharp, broad, answer, probes)
            n = items.n[item]
            grid = np.maximum(8, n // 2)
            low = np.maximum(ends[text] + cell * grid - n // 4, ends[text])
            high = np.minimum(ends[text] + cell * grid + grid + n + n // 4, ends[text + 1])
            runs, shared, rare = np.zeros(len(text), np.int64), np.zeros(len(text)), np.zeros(len(text))
            order = np.lexsort((high - low, items.limbs[item]))
            order = order[high[order] > low[order]]
            at = 0
            while at < len(order):
                limbs = int(items.limbs[item[order[at]]])
                same = order[at : at + max(1, 400_000 // (limbs * max(1, int(high[order[at]] - low[order[at]]))))]
                same = same[items.limbs[item[same]] == limbs]
                at += len(same)
                words, bits = _places(items, flat, low[same], high[same], item[same], limbs)
                runs[same], shared[same] = _longest_runs(bits), _common_subsequences(bits, n[same]) / n[same]
                rare[same] = sum(((words == items.rare[item[same], k, None]).any(axis=1) & (k < items.rares[item[same]])) for k in range(items.rare.shape[1])) / items.rares[item[same]]
            holds = (shared >= common) & (rare >= answer)
            keep = np.flatnonzero(holds | (runs >= run_words))
            # Of a pair's regions one row: the best that holds, with the longest run and greatest cosine of all.
            pair = text[keep] * (len(items.ids) + 1) + item[keep]
            best = keep[np.lexsort((-rare[keep], -shared[keep], ~holds[keep], pair))]
            pair = np.sort(pair)
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
            if len(first):
                one = best[first]
                longest, nearest = np.maximum.reduceat(runs[best], first), np.maximum.reduceat(cosine[best], first) / 1e6
                kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(text[one])), pa.array(items.ids[item[one]]), *[pa.array(x, k) for x, k in zip((longest, np.minimum(nearest, 1.0), shared[one], rare[one]), kinds)]], names)

    return run


def _item_blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list[int], list[str]]]:
    """All texts of all items by id, in blocks of bounded size; read as a stream, one block on the driver at a time."""
    ids, texts, size = [], [], 0
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("k"), F.coalesce(item_text, F.lit("")).alias("v")).distinct().orderBy("k", "v")
    for r in rows.toLocalIterator():
        n = len(word_list(r.v))
        if ids and size + n > ITEM_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.k)
        texts.append(r.v)
        size += n
    if ids:
        yield ids, texts


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", run_words: int = 10,
    sharp: float = SHARP, broad: float = BROAD, common: float = 0.6, answer: float = 0.5, answer_words: int = 4, probes: int | None = PROBES,
) -> DataFrame:
    """(doc_id, item_id, run, cosine, common, answer): documents that hold an item's words in a row, or reworded.

    A candidate region, about two item lengths wide, counts when its longest common run has ``run_words`` words (two
    blocks less one at least, so that none is missed), or when its longest common subsequence has the share ``common`` of the item's
    words and it holds the share ``answer`` of the item's ``answer_words`` rarest words. One row per pair: ``run`` is the
    longest over its regions that count, ``cosine`` the greatest; ``common`` and ``answer`` are those of the best region. All are
    measured in every row.

    NULL texts count as empty; NULL ids are dropped; items of fewer than ``BLOCK`` words have no case; repeated rows of an id
    count once in the result; of an item id with several texts each is searched and the best values count. Items of
    more than ``SEGMENT`` words are searched and measured segment by segment. Extra columns don't matter.
    """
    if run_words < 2 * BLOCK - 1:
        raise ValueError(f"run_words must be {2 * BLOCK - 1} at least")
    spark = docs.sparkSession
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("text"))
    words = scratch.materialize(texts.mapInArrow(_tokenise, "doc long, words array<long>"), "words")
    latent = LatentSpace.fit(words)
    space = spark.sparkContext.broadcast(cloudpickle.dumps(latent))  # by value: executors need not have the package
    out = None
    for ids, block in _item_blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(_Items(ids, block, latent, answer_words)))
        found = words.mapInArrow(_searcher(space, sent, sharp, broad, run_words, common, answer, probes), "doc long, item long, run int, cosine double, common double, answer double")
        found = scratch.materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "doc long, item long, run int, cosine double, common double, answer double")
    best = out.groupBy("doc", "item").agg(F.max("run").alias("run"), F.max("cosine").alias("cosine"), F.max(F.struct("common", "answer")).alias("b"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "run", "cosine", F.col("b.common").alias("common"), F.col("b.answer").alias("answer"))


def leaked_runs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", run_words: int = 10, **settings) -> DataFrame:
    """(doc_id, item_id) of the :func:`leaked_passages` where the document holds ``run_words`` consecutive words of the
    item as consecutive words."""
    found = leaked_passages(docs, items, doc_id, doc_text, item_id, item_text, run_words, **settings)
    return found.where(F.col("run") >= run_words).select(doc_id, item_id)
