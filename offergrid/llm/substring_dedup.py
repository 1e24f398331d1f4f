"""Substring dedup: difference-cover anchors find windows of words that occur more than once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import batched, buckets_of, mix, powers, slices, squeeze, text_buffer, unsqueeze, word_hashes, written

#: Any two positions have a shift below PERIOD that brings both to cover positions: a perfect difference set.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
BLOCK_BYTES, BLOCK_ROWS = 4_000_000, 10_000
_C = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_COVERED = np.isin(np.arange(PERIOD), COVER)
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u4")])


def _pack(batches):
    from pyspark import TaskContext

    made = 0
    for batch in batched(batches, BLOCK_ROWS, BLOCK_BYTES):
        block = (TaskContext.get().partitionId() << 24) + made
        made += 1
        data, offs = text_buffer(batch.column(1))
        ids = np.array([-(1 << 63) if v is None else v for v in batch.column(0).to_pylist()], "<i8")
        lens = np.diff(offs).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([squeeze(ids)], pa.binary()), pa.array([squeeze(lens)], pa.binary()), pa.array([squeeze(data)], pa.binary())], ["block", "ids", "lens", "body"])


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.frombuffer(unsqueeze(row["lens"]), "<u4")
    return np.frombuffer(unsqueeze(row["ids"]), "<i8"), np.frombuffer(unsqueeze(row["body"]), np.uint8), np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])


def _parts(data: np.ndarray, offs: np.ndarray):
    """Word hashes of a block, some texts at a time: (first text, word hashes, word offsets)."""
    for a, b in slices(offs, 1_000_000):
        h, woffs = word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        yield a, h, woffs


def _rolling(h: np.ndarray, base: int, k: int, at: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the k words from each position ``at``."""
    up = powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    down = powers(pow(base, -1, 1 << 64), len(h) + 1)
    return mix((total[at + k] - total[at]) * down[at])


def _places(woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where k words of one text begin, and their positions in that text."""
    n = np.diff(woffs)
    where = np.arange(woffs[-1]) - np.repeat(woffs[:-1], n)
    at = np.flatnonzero(where + k <= np.repeat(n, n))
    return at, where[at]


def _anchors(data, offs, window: int):
    """(hash of each anchor in block order)."""
    k = window - PERIOD + 1
    out = []
    for _, h, woffs in _parts(data, offs):
        at, where = _places(woffs, k)
        out.append(_rolling(h, _C[0], k, at[_COVERED[where % PERIOD]]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _dealt(keys: np.ndarray, field: np.ndarray, buckets: int):
    """Distinct keys sorted by bucket and value, whether each occurs twice, bucket bounds, each input's place."""
    part = (field >> np.uint64(40)).astype(np.int64) % buckets
    order = np.lexsort((field, part)) if keys.dtype.names is None else np.lexsort((keys["b"], field, part))
    sorted_keys, sorted_part = keys[order], part[order]
    new = np.ones(len(keys), bool)
    if len(keys):
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    group = np.cumsum(new) - 1
    place = np.empty(len(keys), np.int64)
    place[order] = group
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(keys)))
    bounds = np.searchsorted(sorted_part[first], np.arange(buckets + 1))
    return sorted_keys[first], count > 1, bounds, place


def _send(keys: np.ndarray, field: np.ndarray, buckets: int, block: int):
    distinct, twice, bounds, _ = _dealt(keys, field, buckets)
    rows = [(b, block, distinct[i:j].tobytes(), np.packbits(twice[i:j]).tobytes()) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if i < j]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary()), "twice": pa.array([r[3] for r in rows], pa.binary())})


def _send_anchors(window: int, buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, data, offs = _unpack(row)
                h = _anchors(data, offs, window)
                yield from _send(h, h, buckets, row["block"]).to_batches()

    return run


def _repeated(kind: int, wide: bool):
    """In one bucket: which keys of each block occur in another block or twice in their own."""

    def run(table: pa.Table) -> pa.Table:
        raw, flags = table.column("keys").to_pylist(), table.column("twice").to_pylist()
        dtype = _WINDOW if wide else np.dtype("<u8")
        keys = np.frombuffer(b"".join(raw), dtype)
        sizes = [len(x) // dtype.itemsize for x in raw]
        twice = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(flags, sizes, strict=True)]).astype(bool)
        order = np.lexsort((keys["b"], keys["a"])) if wide else np.argsort(keys)
        s = keys[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(keys), bool)
        hit[1:] |= same
        hit[:-1] |= same
        # A key that is twice in one block alone is repeated too; if it is in several, the line above has it.
        out = np.zeros(len(keys), bool)
        out[order] = hit
        out |= twice
        ends = np.cumsum(sizes)
        masks = [np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return pa.table({"block": table.column("block"), "kind": pa.array([kind] * len(raw), pa.int32()), "bucket": table.column("bucket"), "mask": pa.array(masks, pa.binary())})

    return run


def _flags(masks: list[dict], kind: int, bounds: np.ndarray) -> np.ndarray:
    """The answers of all buckets for one block, in the order its keys were sent."""
    out = np.zeros(bounds[-1], bool)
    for m in masks:
        if m["kind"] == kind:
            i, j = bounds[m["bucket"]], bounds[m["bucket"] + 1]
            out[i:j] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=j - i).astype(bool)
    return out


def _candidates(data, offs, window: int, buckets: int, masks: list[dict]):
    """Windows that hold a repeated anchor: for each part (first text, word hashes, word offsets, positions)."""
    h = _anchors(data, offs, window)
    _, _, bounds, place = _dealt(h, h, buckets)
    shared = _flags(masks, 1, bounds)[place]
    k, done = window - PERIOD + 1, 0
    for first, words, woffs in _parts(data, offs):
        at, where = _places(woffs, k)
        at = at[_COVERED[where % PERIOD]]
        mark = np.zeros(len(words) + PERIOD + 1, np.int64)
        mark[at[shared[done : done + len(at)]] + 1] = 1
        done += len(at)
        seen = np.cumsum(mark)
        windows, _ = _places(woffs, window)
        yield first, words, woffs, windows[seen[windows + PERIOD] > seen[windows]]


def _window_keys(parts, window: int) -> np.ndarray:
    out = []
    for _, words, _, at in parts:
        keys = np.empty(len(at), _WINDOW)
        if len(at):
            keys["a"] = _rolling(words, _C[0], window, at)
            keys["b"] = (_rolling(words, _C[1], window, at) >> np.uint64(32)).astype(np.uint32)
        out.append(keys)
    return np.concatenate(out) if out else np.empty(0, _WINDOW)


def _send_windows(window: int, buckets: int):
    def run(blocks: pa.Table, masks: pa.Table) -> pa.Table:
        sent = []
        for row in blocks.to_pylist():
            _, data, offs = _unpack(row)
            keys = _window_keys(_candidates(data, offs, window, buckets, masks.to_pylist()), window)
            sent.append(_send(keys, np.ascontiguousarray(keys["a"]), buckets, row["block"]))
        return pa.concat_tables(sent)

    return run


def _finish(window: int, buckets: int):
    def run(blocks: pa.Table, masks: pa.Table) -> pa.Table:
        answers = masks.to_pylist()
        ids_out, text_keys, n_words, spans, kept = [], [], [], [], []
        for row in blocks.to_pylist():
            ids, data, offs = _unpack(row)
            parts = list(_candidates(data, offs, window, buckets, answers))
            keys = _window_keys(parts, window)
            _, _, bounds, place = _dealt(keys, np.ascontiguousarray(keys["a"]), buckets)
            hit, done = _flags(answers, 2, bounds)[place], 0
            body = data.tobytes()
            for first, words, woffs, at in parts:
                own = at[hit[done : done + len(at)]]
                done += len(at)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, own, 1)
                np.add.at(step, own + window, -1)
                gone = np.cumsum(step)[:-1] > 0
                for i in range(len(woffs) - 1):
                    d, a, b = first + i, woffs[i], woffs[i + 1]
                    ids_out.append(None if ids[d] == -(1 << 63) else int(ids[d]))
                    n_words.append(int(b - a))
                    cut, text = gone[a:b], body[offs[d] : offs[d + 1]]
                    text_keys.append(xxhash.xxh64_intdigest(text, 42))
                    found = text.split()
                    if cut.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                        found = [w for w, c in zip(found, cut.tolist(), strict=True) if not c]
                    else:
                        spans.append([])
                    kept.append(b" ".join(found).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": pa.array(ids_out, pa.int64()), "text_key": pa.array(np.array(text_keys, np.uint64).view(np.int64)), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, kind), "kept_text": pa.array(kept, pa.string())})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Remove every word that a repeated window of ``window`` words covers.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is repeated if its word sequence starts at any other place,
    in the same text or another; windows are judged on the input.

    Texts are packed into blocks. Anchors of window-20 words are hashed only where the position modulo 21 is in a
    difference cover: two equal windows always share such an anchor at the same shift. Each block sends its distinct
    anchors once, dealt by hash; a bucket answers with one bit for each, so a passage in a third of all texts costs
    one key for each block. Anchors that recur extend to the windows that hold them; these windows' 96-bit
    hashes make the same round, and the answers mark the words to remove. Nothing is paired.

    Returns id, text_key (xxhash64 of the text), n_words, spans (removed ranges of words, end excluded) and kept_text
    (kept words joined by one space). Null and empty texts have no words; ids are integers, null ids stay null (and -2**63 counts as null); repeated rows repeat each other and lose all
    windows; texts shorter than a window keep all; an empty table gives no rows; other columns are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    buckets = buckets_of(docs.sparkSession)
    blocks = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_pack, "block long, ids binary, lens binary, body binary"), "blocks")
    sent, answer = "bucket int, block long, keys binary, twice binary", "block long, kind int, bucket int, mask binary"
    anchors = blocks.mapInArrow(_send_anchors(window, buckets), sent)
    shared = written(anchors.groupBy("bucket").applyInArrow(_repeated(1, False), answer), "anchors")
    windows = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_windows(window, buckets), sent)
    repeated = written(windows.groupBy("bucket").applyInArrow(_repeated(2, True), answer), "windows")
    return blocks.groupBy("block").cogroup(shared.unionByName(repeated).groupBy("block")).applyInArrow(_finish(window, buckets), "id long, text_key long, n_words long, spans array<struct<start:long,end:long>>, kept_text string")
