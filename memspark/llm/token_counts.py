"""Token counts: segments that are proven to be one token are counted directly, only the rest is merged by the library."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import pieces, put, texts_of, tune

#: Tokens of the longest context that a document may fill.
LIMIT = 4096
#: The tokenizer's mark for a space; both are the same symbol to its merges.
MARK = "▁"
#: Bytes of text that are segmented together, and segments whose merged counts a worker keeps.
PIECE, CACHE = 2 << 20, 1 << 17


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prove(model: bytes) -> tuple[np.ndarray, list[str], str]:
    """(cut, whole, wall) of a BPE model, from its vocabulary alone.

    cut[256 * x + y]: no vocabulary string has byte x as the end of a character and byte y as the start of the next. Every
    symbol that merging makes is a vocabulary string, so none reaches across such a place: what lies on its two sides is
    merged as if it stood alone, and the counts add up. whole: the strings that, standing alone, are encoded as one token;
    each of them is encoded here. wall: a character that is cut off from every other, behind which a string stands alone,
    without the space that the tokenizer puts before a text.
    """
    sp = load(model)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    strings = {sp.id_to_piece(i).replace(MARK, " "): i for i in plain}
    cut = np.ones(1 << 16, bool)
    cut.reshape(256, 256)[:, 0x80:0xC0] = False  # inside a character
    for s in strings:
        chars = [c.encode() for c in s]
        for a, b in zip(chars, chars[1:], strict=False):
            cut[a[-1] << 8 | b[0]] = False
    grid = cut.reshape(256, 256)
    starts = np.r_[0:0x80, 0xC0:256]
    walls = [c for c in "\n\t\x00\x01" if grid[ord(c), starts].all() and grid[:, ord(c)].all()]
    if not walls or sp.encode("") or [len(sp.encode(x)) for x in (" a", MARK + "a")] != [len(sp.encode(walls[0] + "  a")) - len(sp.encode(walls[0]))] * 2:
        raise ValueError("not a model that puts one space before a text and keeps white space")
    before = len(sp.encode(walls[0]))
    codes = sp.encode([walls[0] + s for s in strings])
    return cut, [s for (s, i), c in zip(strings.items(), codes, strict=True) if c[before:] == [i]], walls[0]


def segments(texts: pa.Array, cut: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts end to end, and n + 1 places of the texts among them. A text's first has the space put before it."""
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    data, off = texts_of(pa.RecordBatch.from_arrays([texts], names=["t"]), "t")
    new = np.zeros(len(data), bool)
    new[1:] = cut[data[:-1].astype(np.uint16) << 8 | data[1:]]
    new[off[:-1][np.diff(off) > 0]] = True
    at = np.append(np.flatnonzero(new), len(data)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    return found, np.searchsorted(at[:-1], off)


def counter(model: bytes, cut: np.ndarray, whole: pa.Array, wall: str):
    """texts -> number of tokens of each."""
    sp, known = load(model), {}
    before = len(sp.encode(wall))

    def merged(rest: list[bytes]) -> list[int]:
        if len(known) + len(rest) > CACHE:
            known.clear()
        new = [s for s in rest if s not in known]
        found = dict(zip(new, (len(c) - before for c in sp.encode([wall + s.decode() for s in new])), strict=True)) if new else {}
        known.update((s, n) for s, n in found.items() if len(s) <= 64 and len(known) < CACHE)
        return [found[s] if s in found else known[s] for s in rest]

    def count(texts: pa.Array) -> np.ndarray:
        found, place = segments(texts, cut)
        coded = found.dictionary_encode()
        words, n = coded.dictionary, np.ones(len(coded.dictionary), np.int64)
        rest = pc.is_null(pc.index_in(words, value_set=whole)).to_numpy(zero_copy_only=False)
        n[rest] = merged(words.filter(pa.array(rest)).to_pylist())
        total = np.append(0, np.cumsum(n[coded.indices.to_numpy()]))
        return np.diff(total[place])

    return count


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    n_tokens is what the sentencepiece library gives for the whole text with the BPE model at model_path (by default the
    public 32k one), without begin and end tokens; special strings inside a text are plain text. Texts are cut where no
    token can cross; what the offline proof shows to be one token counts as one, each other distinct segment of a batch
    is encoded once. Nulls and empty texts have no bytes and no tokens. Ids may be null or repeated, each row is counted on
    its own; an empty table gives no rows; further columns, whatever their names, are ignored. The model and the proven
    strings (bounded by the vocabulary) are read and made on the driver, and broadcast.
    """
    spark = docs.sparkSession
    tune(spark)
    with open(model_path or default_path(), "rb") as f:
        model = f.read()
    cut, whole, wall = prove(model)
    sent = spark.sparkContext.broadcast((model, cut.tobytes(), [s.encode() for s in whole], wall))

    def run(batches):
        body, table, strings, mark = sent.value
        count = counter(body, np.frombuffer(table, bool), pa.array(strings, pa.large_binary()), mark)
        for b in pieces(batches, "text", PIECE):
            n, (_, off) = count(b.column(b.schema.get_field_index("text"))), texts_of(b, "text")
            yield put(b.select(["doc_id"]), n_bytes=pa.array(np.diff(off)), n_tokens=pa.array(n), over_limit=pa.array(n > limit))

    slim = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return slim.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
