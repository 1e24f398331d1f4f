"""Byte-level BPE: each distinct word is encoded once for the whole corpus, then ids go back to every position."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offergrid.llm.common import batched, bucketed, buckets_of, squeeze, unsqueeze

BLOCK_BYTES, BLOCK_ROWS = 16_000_000, 50_000
PACKED = "kind int, bucket int, block long, payload binary, places binary, ids binary, lens binary"


def read_ranks(path: str, most: int = 1_000_000) -> dict[bytes, int]:
    """A rank file: base64 token and id on each line. The vocabulary is broadcast, so its size is checked."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    if len(ranks) > most:
        raise ValueError(f"{path}: {len(ranks)} tokens; at most {most} are broadcast")
    return ranks


def bpe_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until no pair is a token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _bpe_long(word, ranks)
    scores = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while scores:
        low = min(scores)
        if low == _NONE:
            break
        i = scores.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


_NONE = 1 << 40


def _bpe_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over linked parts, for words of any length in n log n."""
    import heapq

    n = len(word)
    end, prev, following, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = following[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], alive[j], following[i] = end[j], False, following[j]
        if following[i] < n:
            prev[following[i]] = i
            if (r := ranks.get(word[i : end[following[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[following[i]]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, prev[i], end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _planes(values: np.ndarray) -> bytes:
    """uint32 values below 2**24 as three byte planes, compressed: frequent words have small numbers."""
    cut = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return b"".join(len(z := squeeze(np.ascontiguousarray(cut[:, k]))).to_bytes(4, "little") + z for k in range(4))


def _unplanes(raw: bytes) -> np.ndarray:
    planes, at = [], 0
    for _ in range(4):
        n = int.from_bytes(raw[at : at + 4], "little")
        planes.append(np.frombuffer(unsqueeze(raw[at + 4 : at + 4 + n]), np.uint8))
        at += 4 + n
    return np.ascontiguousarray(np.stack(planes, 1)).view("<u4").ravel() if len(planes[0]) else np.zeros(0, np.uint32)


def _join(one: bytes, two: bytes) -> bytes:
    return len(one).to_bytes(4, "little") + one + two


def _part(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(raw[:4], "little")
    return _unplanes(raw[4:cut]), _unplanes(raw[cut:])


def _bytes_list(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), "<u4", len(words))
    return squeeze(len(words).to_bytes(4, "little") + lens.tobytes() + b"".join(words))


def _unbytes(raw: bytes) -> list[bytes]:
    body = unsqueeze(raw)
    n = int.from_bytes(body[:4], "little")
    ends = np.cumsum(np.frombuffer(body, "<u4", n, 4)) + 4 + 4 * n
    at, out = 4 + 4 * n, []
    for e in ends.tolist():
        out.append(body[at:e])
        at = e
    return out


def _pack(pattern: str, buckets: int):
    def run(batches):
        import zlib

        from pyspark import TaskContext

        find, made = regex.compile(pattern).findall, 0
        for batch in batched(batches, BLOCK_ROWS, BLOCK_BYTES):
            block = (TaskContext.get().partitionId() << 24) + made
            made += 1
            seen: dict[str, int] = {}
            number = seen.setdefault
            parts, counts = [], []
            for text in batch.column(1).to_pylist():
                words = find(text) if text else []
                parts.append(np.fromiter([number(w, len(seen)) for w in words], np.uint32, len(words)))
                counts.append(len(words))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            # Number the words by bucket and, in a bucket, by bytes, so that the lists that travel compress well.
            words = [w.encode() for w in seen]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
            times = np.bincount(flat, minlength=len(words))
            often = np.argsort(-times, kind="stable")
            new = np.empty(len(words), np.uint32)
            new[often] = np.arange(len(words), dtype=np.uint32)
            out = [(0, None, block, _planes(new[flat]), _planes(new[order]), squeeze(np.array(batch.column(0).to_pylist(), object).astype("<i8") if batch.column(0).null_count == 0 else np.array([-(1 << 63) if v is None else v for v in batch.column(0).to_pylist()], "<i8")), squeeze(np.array(counts, "<u4")))]
            begin = 0
            while begin < len(order):
                b, stop = bucket[order[begin]], begin
                while stop < len(order) and bucket[order[stop]] == b:
                    stop += 1
                own = order[begin:stop]
                out.append((1, int(b), block, _bytes_list([words[i] for i in own]), None, None, None))
                begin = stop
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64]), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["kind", "bucket", "block", "payload", "places", "ids", "lens"])

    return run


def _encode_bucket(shared):
    def run(batches):
        ranks, done = shared.value, {}
        for batch in batches:
            blocks, payloads = batch.column("block"), batch.column("payload").to_pylist()
            sent = []
            for raw in payloads:
                ids = []
                for w in _unbytes(raw):
                    got = done.get(w)
                    if got is None:
                        got = done[w] = np.array(bpe_word(w, ranks), np.uint32)
                    ids.append(got)
                sent.append(_join(_planes(np.fromiter(map(len, ids), "<u4", len(ids))), _planes(np.concatenate(ids))))
            yield pa.RecordBatch.from_arrays([blocks, batch.column("bucket"), pa.array(sent, pa.binary())], ["block", "bucket", "payload"])

    return run


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each (start, len), joined."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lens, lens) + np.repeat(starts, lens)


def _reassemble(shared):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        ranks = shared.value
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        token_len = np.fromiter(map(len, table), np.int64, len(table))
        token_at = np.cumsum(token_len) - token_len
        token_bytes = np.frombuffer(b"".join(table), np.uint8)
        # Bundles joined by bucket are the block's words in the order in which its places were written.
        bundles = sorted(zip(words.column("bucket").to_pylist(), words.column("payload").to_pylist(), strict=True))
        parts = [_part(raw) for _, raw in bundles]
        flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
        all_lens = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        all_begin = np.cumsum(all_lens) - all_lens
        out_ids, out_list, out_bytes = [], [], []
        for payload, places, ids, counts in zip(*[docs.column(c).to_pylist() for c in ("payload", "places", "ids", "lens")], strict=True):
            place = _unplanes(places)
            length, begin = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            length[place], begin[place] = all_lens, all_begin
            doc_ids, n_words, at = np.frombuffer(unsqueeze(ids), "<i8"), np.frombuffer(unsqueeze(counts), "<u4"), 0
            where = _unplanes(payload)
            for doc, n in zip(doc_ids.tolist(), n_words.tolist(), strict=True):
                own = where[at : at + n]
                at += n
                tokens = flat[_ragged(begin[own], length[own])]
                out_ids.append(None if doc == -(1 << 63) else doc)
                out_list.append(tokens.astype(np.int32))
                out_bytes.append(token_bytes[_ragged(token_at[tokens], token_len[tokens])].tobytes())
        offs = np.concatenate([[0], np.cumsum([len(x) for x in out_list])]).astype(np.int32)
        values = pa.array(np.concatenate(out_list) if out_list else np.zeros(0, np.int32), pa.int32())
        return pa.table({"id": pa.array(out_ids, pa.int64()), "tokens": pa.ListArray.from_arrays(pa.array(offs), values), "decoded": pa.array(out_bytes, pa.binary())})

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens ARRAY<INT>, decoded BINARY) for every text, encoded by the rank file and decoded again.

    Tasks cut texts into pre-tokens by ``pattern`` and pack blocks of texts: the distinct words of a block, bundled
    by hash bucket, and each position's word number. The bundles are dealt out by bucket; a task keeps one entry for
    each distinct word and encodes it once. Ids return to the block, where positions are looked up and the
    ids decoded through the token-byte table. Blocks are stored bucketed, so only words and ids are shuffled; they hold at most 16 MB of text, or one longer text.

    Null texts count as empty and give no tokens; null ids stay null; repeated rows give repeated results; an
    empty table gives none; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    buckets = buckets_of(spark)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = bucketed(given.mapInArrow(_pack(pattern, buckets), PACKED), "bpe", "kind", "block", buckets)
    bundles = packed.where("kind = 1").select("bucket", "block", "payload").repartition(buckets, "bucket")
    encoded = bundles.mapInArrow(_encode_bucket(ranks), "block long, bucket int, payload binary")
    texts = packed.where("kind = 0").select("block", "payload", "places", "ids", "lens")
    return texts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_reassemble(ranks), "id long, tokens array<int>, decoded binary")
