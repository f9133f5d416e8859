"""Byte-level BPE encoding and decoding with a public vocabulary, each distinct word encoded once.

Texts are cut into pre-tokens (contractions; letters, digits or signs with a leading space; white
space) by numpy on whole blocks of documents, following the vocabulary's public pattern exactly. A
block's pre-tokens with their positions stay together as one packed sequence of local word numbers;
its distinct words go, packed, to the shard of their hash; there are as many shards as the bytes of
text need. A shard takes in its blocks' words batch by batch, encodes every distinct word once, whatever
number of blocks ask for it, and answers each block with packed ids. Blocks and
answers are joined by block, and documents reassembled by position. A block is named by a hash of its
content, so both sides name it alike when a lost executor's work is done again; an answer that is
missing is an error, never a gap. Decoding joins the ids with the token-byte table, whose size is
that of the vocabulary.

Defined cases
- A null text has null token_ids and decodes to null; an empty text has none and decodes to "".
- Decoding null ids gives null; an id outside the table is an error; bytes that aren't UTF-8 become
  U+FFFD (ids made by encoding always are).
- Special tokens in a text are ordinary text.
- Ids are of any type. Every row gets a row, also repeated ones and such without id; a text of any length is one document;
  extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, pieces, release, span_hashes, text_buffer, tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a block, and tokens that a worker expands at a time.
BLOCK = 1 << 22
EXPAND = 1 << 20
#: Bytes of text whose distinct words make up a shard.
SHARD_BYTES = 16 << 20

_L, _N, _S, _O = 1, 2, 3, 0
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_cache: dict = {}


def _classes() -> np.ndarray:
    if "classes" not in _cache:
        kind = {"L": _L, "N": _N}
        t = np.array([kind.get(unicodedata.category(chr(c))[0], _O) for c in range(0x110000)], np.uint8)
        t[_SPACES] = _S
        _cache["classes"] = t
    return _cache["classes"]


def vocabulary(path: str) -> tuple[tiktoken.Encoding, np.ndarray, np.ndarray]:
    """The encoder and the token-byte table (bytes, offsets by id) of a rank file; loaded once a process."""
    if path not in _cache:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(ranks.values()) + 1
        lens = np.zeros(size + 1, np.int64)
        parts = [b""] * size
        for token, k in ranks.items():
            parts[k] = token
            lens[k + 1] = len(token)
        enc = tiktoken.Encoding("lectern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _cache[path] = enc, np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens)
    return _cache[path]


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pre-tokens and their offsets by row; a pre-token ends where the next begins."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cp)
    c = _classes()[cp]
    head = np.zeros(n, bool)  # first character of a row
    first = offs[:-1][np.diff(offs) > 0]
    head[np.searchsorted(at, first)] = True
    run = head.copy()
    run[1:] |= c[1:] != c[:-1]
    space = c == _S
    plain = np.zeros(n, bool)  # a blank before, in the same row
    plain[1:] = (cp[:-1] == 32) & ~head[1:]
    start = run & (space | ~plain)
    inner = np.zeros(n, bool)  # the last white space before other characters, if it isn't the only one
    inner[:-1] = space[:-1] & ~space[1:] & ~head[1:] & ~run[:-1]
    start |= inner
    for i in np.flatnonzero(start[:-1] & (cp[:-1] == 39)):
        text = "".join(map(chr, cp[i + 1 : i + 3]))
        size = 2 if text in ("re", "ve", "ll") else 1 if text[:1] in ("s", "t", "m", "d") else 0
        if size and not head[i + 1 : i + 1 + size].any():
            start[i + 1 : i + 1 + size] = False
            if i + 1 + size < n:
                start[i + 1 + size] = True
    begin = at[start]
    return begin, np.searchsorted(begin, offs)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _blocks(column):
    """(first row, next row, name, bytes, pre-token starts, ends, offsets, sorted distinct hashes, one place, local number) by block."""
    data, offs = text_buffer(column)
    for i, j in pieces(offs, BLOCK):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        name = int.from_bytes(hashlib.blake2b(d.tobytes() + o.tobytes(), digest_size=8).digest(), "little", signed=True)
        starts, ends, hashes, counts = [], [], [], []
        for a, b in pieces(o):
            s, po = pretokens(d[o[a] : o[b]], o[a : b + 1] - o[a])
            e = np.append(s[1:], o[b] - o[a])[: len(s)]
            hashes.append(span_hashes(d[o[a] : o[b]], s, e))
            starts.append((s + o[a]).astype(np.int32 if o[-1] < 1 << 31 else np.int64))
            ends.append((e - s).astype(np.int32))
            counts.append(np.diff(po))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        distinct, place, local = np.unique(h, return_index=True, return_inverse=True)
        yield i, j, name, d, np.concatenate(starts), np.concatenate(ends), np.concatenate(counts), distinct, place, local.astype(np.int32)


def _words_of(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, name, d, start, length, _, distinct, place, _ in _blocks(batch.column(1)):
                if not len(distinct):
                    continue
                s, n = start[place].astype(np.int64), length[place].astype(np.int64)
                cum = np.concatenate([[0], np.cumsum(n)])
                flat = d[np.repeat(s - cum[:-1], n) + np.arange(cum[-1])]
                cut = np.searchsorted((distinct >> np.uint64(32)).astype(np.int64) * shards >> 32, np.arange(shards + 1))
                ks = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ks.astype(np.int32)), pa.array(np.full(len(ks), name)),
                     pa.array([_pack(n[cut[k] : cut[k + 1]].astype(np.int32)) for k in ks], pa.binary()),
                     pa.array([_pack(flat[cum[cut[k]] : cum[cut[k + 1]]]) for k in ks], pa.binary())],
                    ["shard", "block", "lens", "bytes"],
                )

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block: document ids, pre-token counts (-1: null text) and the packed local word numbers."""
    for batch in batches:
        null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        for i, j, name, _, _, _, count, distinct, _, local in _blocks(batch.column(1)):
            often = np.bincount(local, minlength=len(distinct))
            top = np.argsort(-often, kind="stable")[:255].astype(np.int32)  # one byte each; 255 announces a number of three or more
            short = np.full(len(distinct), 255, np.uint8)
            short[top] = np.arange(len(top))
            code = short[local]
            rest = local[code == 255].view(np.uint8).reshape(-1, 4).T
            c = np.where(null[i:j], -1, count).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([batch.column(0).slice(i, j - i)], pa.list_(batch.column(0).type)), pa.array([_pack(c)], pa.binary()),
                 pa.array([_pack(top)], pa.binary()), pa.array([_pack(code)], pa.binary()), pa.array([_pack(np.ascontiguousarray(rest))], pa.binary())],
                ["block", "ids", "counts", "top", "code", "rest"],
            )


def _encode_shard(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _, _ = vocabulary(path)
        ranks, single = enc._mergeable_ranks, enc._core_bpe.encode_single_piece
        done: dict[bytes, tuple[int, ...]] = {}  # the distinct words of the shard so far

        def tokens(word: bytes) -> tuple[int, ...]:
            found = done.get(word)
            if found is None:
                one = ranks.get(word)
                found = done[word] = tuple(single(word)) if one is None else (one,)
            return found

        for table in batches:
            lens = [_unpack(b, np.int32) for b in table.column("lens").to_pylist()]
            flat = [_unpack(b, np.uint8) for b in table.column("bytes").to_pylist()]
            ends = [np.cumsum(n, dtype=np.int64) for n in lens]
            hashes = np.concatenate([span_hashes(b, e - n, e) for n, b, e in zip(lens, flat, ends, strict=True)])
            distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            bases = np.cumsum([0] + [len(n) for n in lens])
            row = np.searchsorted(bases, place, side="right") - 1
            raw, ids = [b.tobytes() for b in flat], []
            sizes = np.zeros(len(distinct), np.int64)
            for k, (r, p) in enumerate(zip(row.tolist(), (place - bases[row]).tolist(), strict=True)):
                e = int(ends[r][p])
                found = tokens(raw[r][e - int(lens[r][p]) : e])
                ids.extend(found)
                sizes[k] = len(found)
            flat_ids, first = np.array(ids, np.int32), np.cumsum(sizes) - sizes
            out_n, out_ids = [], []
            for r in range(len(lens)):
                w = inverse[bases[r] : bases[r + 1]]
                n = sizes[w]
                cum = np.cumsum(n)
                out_n.append(_pack(n.astype(np.int32)))
                out_ids.append(_pack(np.ascontiguousarray(flat_ids[np.repeat(first[w] - cum + n, n) + np.arange(int(n.sum()))].view(np.uint8).reshape(-1, 4).T)))
            yield pa.RecordBatch.from_arrays([table.column("block"), table.column("shard"), pa.array(out_n, pa.binary()), pa.array(out_ids, pa.binary())], ["block", "shard", "sizes", "tokens"])
        release()

    return run


def _planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
    kind = left.schema.field("ids").type.value_type
    answers = {r["shard"]: r for r in right.to_pylist()}  # blocks of equal content have equal answers
    order = sorted(answers)
    sizes = np.concatenate([_unpack(answers[k]["sizes"], np.int32) for k in order] or [np.zeros(0, np.int32)]).astype(np.int64)
    tokens = np.concatenate([_planes(answers[k]["tokens"]) for k in order] or [np.zeros(0, np.int32)])
    first = np.cumsum(sizes) - sizes
    ids, lists = [], []
    for row in left.to_pylist():
        code, top = _unpack(row["code"], np.uint8), _unpack(row["top"], np.int32)
        local = np.zeros(len(code), np.int64)
        short = code < 255
        local[short] = top[code[short]]
        local[~short] = _planes(row["rest"])
        if len(local) and local.max() >= len(sizes):
            raise RuntimeError("a block's words have no ids: the documents changed between two readings of them")
        cum = np.cumsum(sizes[local])
        flat = np.empty(int(cum[-1]) if len(cum) else 0, np.int32)
        for a in range(0, len(local), EXPAND):
            x = local[a : a + EXPAND]
            n, to = sizes[x], cum[a : a + EXPAND]
            lo = int(to[0] - n[0])
            flat[lo : int(to[-1])] = tokens[np.repeat(first[x] - (to - n - lo), n) + np.arange(int(to[-1]) - lo)]
        count = _unpack(row["counts"], np.int32)
        by = np.concatenate([[0], np.cumsum(np.maximum(count, 0))])
        offs = np.concatenate([[0], cum])[by].astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(flat), mask=pa.array(count < 0)))
        ids.append(pa.array(row["ids"], kind))
    release()
    return pa.Table.from_arrays([pa.chunked_array(ids, kind), pa.chunked_array(lists, pa.list_(pa.int32()))], ["doc_id", "token_ids"])


def encode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(doc_id, token_ids) of every row; the cases are defined above."""
    need(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = dict(rows.dtypes)["id"]
    shards = shards or max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // SHARD_BYTES))
    words = rows.mapInArrow(tidy(_words_of(shards)), "shard int, block bigint, lens binary, bytes binary")
    answers = words.groupBy("shard").applyInArrow(_encode_shard(path), "block bigint, shard int, sizes binary, tokens binary")
    blocks = rows.mapInArrow(tidy(_sequences), f"block bigint, ids array<{kind}>, counts binary, top binary, code binary, rest binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_reassemble, f"doc_id {kind}, token_ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """The rows with the text of their ids in `out_col`, by a join with the token-byte table."""
    need(encoded, ids_col)
    k = encoded.columns.index(ids_col)
    keep = [x for x in encoded.columns if x != out_col]
    place = [encoded.columns.index(x) for x in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, at = vocabulary(path)
        for whole in batches:
            offs = whole.column(k).offsets.to_numpy().astype(np.int64)
            for i, j in pieces(offs - offs[0], EXPAND):
                batch = whole.slice(i, j - i)
                column = batch.column(k)
                ids = column.values.to_numpy(zero_copy_only=False)[offs[i] : offs[j]]
                if len(ids) and (ids.min() < 0 or ids.max() >= len(at) - 1):
                    raise ValueError("a token id isn't in the table")
                n = at[ids + 1] - at[ids]
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = table[np.repeat(at[ids] - ends[:-1], n) + np.arange(ends[-1])]
                rows = ends[offs[i : j + 1] - offs[i]]
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(rows.tobytes()), pa.py_buffer(flat.tobytes())])
                try:
                    text = raw.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())
                if column.null_count:
                    text = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([*(batch.column(p) for p in place), text], [*keep, out_col])

    schema = encoded.select(*[f"`{x}`" for x in keep]).schema.add(out_col, "string")
    return encoded.mapInArrow(tidy(run), schema)


def encode_decode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, n_tokens, text): the ids of every document and the text they decode to."""
    coded = encode(docs, path, id_col, text_col).withColumn("n_tokens", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")))
    return decode(coded, path)
