"""Token ids of a whole corpus with a public byte-level tokenizer, shared content encoded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.runtime import fields

#: Folder of the public vocabularies.  A parameter everywhere; the files are not part of this repository.
VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: How a byte-level tokenizer of this family cuts text into words before merging bytes (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as the pattern's engine knows it (fixed value), and the run of it that is taken out beforehand.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 20_000

#: Bytes the rolling hash looks back on, bits of it that must be set at a cut, least bytes between cuts.
WINDOW, CUT_BITS, LEAST_CHUNK = 32, 9, 64
#: The first occurrences of a chunk in a map task go to the one reducer all tasks share for it; of further
#: ones SPREAD_AFTER of each of TASKS_TOGETHER neighbouring tasks go to a reducer of their own.
FIRST_TOGETHER, SPREAD_AFTER, TASKS_TOGETHER = 4, 64, 8
#: Bytes handled at once by array operations.
BLOCK = 1 << 20


def vocabulary_bytes(directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> bytes:
    with open(f"{directory}/{name}", "rb") as f:
        return f.read()


def encoder(raw: bytes):
    """The tokenizer of a vocabulary file's content, made once per Python process."""
    import base64
    import hashlib
    import sys

    kept = sys.__dict__.setdefault("_strandlog_encoders", {})
    key = hashlib.md5(raw).digest()
    if key not in kept:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        kept[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def _gear_table():
    """256 pseudo-random words, made by a rule so that every run cuts alike."""
    import numpy as np

    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x.astype(np.uint32)


def rolling_cuts(data):
    """Places (byte offsets) where the hash of the WINDOW bytes before has its CUT_BITS low bits set.

    The hash of a window is the sum of the bytes' words, each rotated by its distance; it is
    built for all places at once by doubling the window.
    """
    import numpy as np

    table, mask = _gear_table(), np.uint32((1 << CUT_BITS) - 1)
    found = []
    for a in range(0, len(data), BLOCK):
        start = max(0, a - WINDOW + 1)
        h = table[data[start : a + BLOCK]]
        width, turn = 1, 1
        while width < WINDOW:
            older = h[:-width]
            h[width:] += (older << np.uint32(turn)) | (older >> np.uint32(32 - turn))
            width, turn = width * 2, (turn * 2) % 32 or 1
        at = np.flatnonzero((h & mask) == mask) + start + 1
        found.append(at[at > a])
    at = np.concatenate(found) if found else np.empty(0, np.int64)
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]  # never inside a character


def _kinds():
    """1 for ASCII letters, 2 for digits, 3 for other visible ASCII characters, 0 for all other bytes."""
    import numpy as np

    return np.array([0 if not 32 < b < 127 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


def sure_boundaries(data):
    """Places where the tokenizer is certain to begin a new word, whatever stands around them.

    1. White space after something else: no word goes on over white space, and white space
       does not look back.
    2. An ideographic comma or full stop after a common CJK character or a Hiragana letter:
       runs of letters end at punctuation.
    3. Between ASCII characters of different kind (letter, digit, symbol), which no word but
       a contraction joins: not between an apostrophe and a letter.  Code, addresses and
       encoded data without white space are cut here.
    4. A Thai consonant after a Thai vowel sign or tone mark: marks are no letters.

    A text without any of these is one run of letters, digits or symbols over its whole
    length, or nearly so, and one word to the tokenizer too.
    """
    import numpy as np

    found, kinds = [], _kinds()
    for a in range(0, len(data), BLOCK):
        start = max(0, a - 3)
        d = data[start : a + BLOCK + 2]
        space = (d == 32) | ((d >= 9) & (d <= 13))
        # Multi-byte white space before counts as white space: only bytes of ASCII non-space are sure without decoding,
        # and bytes that end a character outside the few blocks that hold white space.
        plain = ((d > 32) & (d < 127)) | (d >= 0x80)
        at = np.flatnonzero(space[1:] & plain[:-1]) + 1
        wide = d[at - 1] >= 0x80
        if wide.any():
            w = at[wide]
            # The last character before, if it is of two or three bytes: exclude U+0085, U+00A0 and all of U+1680, U+2000 to U+206F, U+3000.
            b2 = np.where(w >= 2, d[w - 2], 0)
            b3 = np.where(w >= 3, d[w - 3], 0)
            unsure = (b2 == 0xC2) | ((b3 == 0xE1) & (b2 == 0x9A)) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80)) | (w < 3)
            keep = np.ones(len(at), bool)
            keep[np.flatnonzero(wide)[unsure]] = False
            at = at[keep]
        if len(d) >= 6:
            i = np.arange(3, len(d) - 2)
            stop = i[(d[3:-2] == 0xE3) & (d[4:-1] == 0x80) & ((d[5:] == 0x81) | (d[5:] == 0x82))]
            lead, mid, end = d[stop - 3], d[stop - 2], d[stop - 1]
            letter = ((lead >= 0xE5) & (lead <= 0xE8)) | ((lead == 0xE3) & (mid == 0x81) & (end != 0x80))
            at = np.union1d(at, stop[letter])
        kind = kinds[d]
        change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ~((d[:-1] == 39) & (kind[1:] == 1))) + 1
        at = np.union1d(at, change)
        if len(d) >= 6 and (d == 0xE0).any():
            i = np.flatnonzero(d[3:-2] == 0xE0) + 3
            consonant = (d[i + 1] == 0xB8) & (d[i + 2] >= 0x81) & (d[i + 2] <= 0xAE)
            low, high = (d[i - 2] == 0xB8), (d[i - 2] == 0xB9)
            mark = (d[i - 3] == 0xE0) & ((low & ((d[i - 1] == 0xB1) | ((d[i - 1] >= 0xB4) & (d[i - 1] <= 0xBA)))) | (high & (d[i - 1] >= 0x87) & (d[i - 1] <= 0x8E)))
            at = np.union1d(at, i[consonant & mark])
        at = at + start
        found.append(at[(at > a if a else at > 0) & (at <= a + BLOCK)])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def pieces(data, starts, ends):
    """Cut the texts lying in ``data`` at ``starts`` to ``ends`` (none empty): piece offsets and which are joints.

    Where a rolling-hash cut is no sure boundary, the text from the sure boundary before it
    to the one after is a joint: encoded in its context, which reaches to sure boundaries on
    both sides, so chunks and joints agree exactly with the encoding of the whole text.
    """
    import numpy as np

    cuts = rolling_cuts(data)
    owner = np.searchsorted(starts, cuts, "right") - 1
    ok = (cuts - starts[owner] >= WINDOW) & (cuts < ends[owner])
    cuts, owner = cuts[ok], owner[ok]
    if len(cuts) > 1 and (np.diff(cuts) < LEAST_CHUNK).any():
        kept, last, last_owner = [], -LEAST_CHUNK, -1
        for i, (c, o) in enumerate(zip(cuts.tolist(), owner.tolist())):
            if o != last_owner or c - last >= LEAST_CHUNK:
                kept.append(i)
                last, last_owner = c, o
        cuts = cuts[kept]
    sure = np.union1d(sure_boundaries(data), np.concatenate([starts, ends]))
    at = np.searchsorted(sure, cuts, "left")
    exact = sure[at] == cuts
    left, right = sure[at[~exact] - 1], sure[at[~exact]]
    edges = np.unique(np.concatenate([starts, ends, cuts[exact], left, right]))
    return edges, np.isin(edges[:-1], left)


def _texts(column):
    """Bytes of each text of an Arrow column; null is empty, and what is no UTF-8 is replaced."""
    import pyarrow as pa

    try:
        column.validate(full=True)
        return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]
    except pa.ArrowInvalid:
        return [t.as_buffer().to_pybytes().decode("utf-8", "replace").encode() if t.is_valid else b"" for t in column]


def _chunk(vocabulary, code: str):
    """Map task: texts to chunks (digest, first copies with their text) and encoded joints."""

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        context = TaskContext.get()
        tasks = ((context.partitionId() if context else 0) // TASKS_TOGETHER) % (1 << 15)
        enc = encoder(vocabulary.value)
        seen: dict[bytes, int] = {}

        def batch_of(source, rows, seq, digest, salt, body, ids):
            at = pa.array(rows, pa.int64())
            columns = [source.column("doc").take(at), source.column("id").take(at), pa.array(seq, pa.int32()), pa.array(digest, pa.binary()), pa.array(salt, pa.int32()), pa.array(body, pa.binary()).cast(pa.string()), pa.array(ids, pa.binary())]
            return pa.record_batch(columns, names=["doc", "id", "seq", "digest", "salt", "body", "ids"])

        def group(source, rows, texts):
            """Pieces of some texts (none empty) of the Arrow batch ``source`` as one batch."""
            raw = b"".join(texts)
            data = np.frombuffer(raw, np.uint8)
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes)
            edges, joint = pieces(data, ends - sizes, ends)
            owner = (np.searchsorted(ends - sizes, edges[:-1], "right") - 1).tolist()
            out = ([], [], [], [], [], [])
            before, seq = -1, 0
            for o, j, a, z in zip(owner, joint.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
                seq = seq + 1 if o == before else 0
                before = o
                part = raw[a:z]
                digest = xxhash.xxh3_128_digest(part)
                if j:
                    row = (rows[o], seq, digest, 0, None, encode(enc, part.decode(), code))
                else:
                    n = seen.get(digest, 0)
                    seen[digest] = n + 1
                    if n < FIRST_TOGETHER:
                        salt, first = 0, n == 0
                    else:
                        turn, place = divmod(n - FIRST_TOGETHER, SPREAD_AFTER)
                        salt, first = 1 + (tasks << 16) + turn % 65_535, place == 0
                    row = (rows[o], seq, digest, salt, part if first else None, None)
                for column, v in zip(out, row):
                    column.append(v)
            return batch_of(source, *out)

        for b in batches:
            rows, texts, held, none = [], [], 0, []
            for r, t in enumerate(_texts(b.column("text"))):
                if not t:
                    none.append(r)
                    continue
                rows.append(r)
                texts.append(t)
                held += len(t)
                if held >= BLOCK:
                    yield group(b, rows, texts)
                    rows, texts, held = [], [], 0
            if rows:
                yield group(b, rows, texts)
            if none:
                n = len(none)
                yield batch_of(b, none, [0] * n, [r.to_bytes(4, "big") for r in none], [0] * n, [None] * n, [b""] * n)

    return work


def ordinary(enc, text: str) -> list[int]:
    """Token ids of a text, also where it holds runs of white space too long for the pattern's engine.

    Such a run is a word of its own: all of it at the end of a text, else all but its last
    character, since white space before something else leaves one to it.
    """
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    import re

    out, done = [], 0
    for m in re.finditer(f"[{WHITE_SPACE}]{{{LONG_RUN},}}", text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[done : m.start()])
        out += enc._encode_single_piece(text[m.start() : stop])
        done = stop
    return out + enc.encode_ordinary(text[done:])


def encode(enc, text: str, code: str) -> bytes:
    """Token ids as machine words of the array type ``code``."""
    import array

    return array.array(code, ordinary(enc, text)).tobytes()


def _encode_once(vocabulary, code: str):
    """Reduce task: rows sorted by (digest, salt, body missing); the first row of a chunk has its text."""

    def work(batches):
        import pyarrow as pa

        enc = encoder(vocabulary.value)
        key, ids = None, b""
        for b in batches:
            out = []
            for digest, salt, body, done in zip(*(b.column(c).to_pylist() for c in ("digest", "salt", "body", "ids"))):
                if done is None:
                    if key != (digest, salt):
                        if body is None:
                            raise AssertionError("a chunk came without its text")
                        key, ids = (digest, salt), encode(enc, body, code)
                    done = ids
                out.append(done)
            yield pa.record_batch([b.column("doc"), b.column("id"), b.column("seq"), pa.array(out, pa.binary())], names=["doc", "id", "seq", "ids"])

    return work


def _assemble(code: str):
    """Rows sorted by (doc, seq): the pieces of a document in order become its list of ids."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        kind = np.dtype(code)

        def put(names, parts, id_type):
            sizes = np.array([len(p) for p in parts], np.int64) // kind.itemsize
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.frombuffer(b"".join(parts), kind).astype(np.int32)
            return pa.record_batch([pa.array(names, id_type), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], names=["id", "ids"])

        doc, name, held, id_type = None, None, [], None
        for b in batches:
            id_type = b.schema.field("id").type
            names, parts, size = [], [], 0
            for d, i, x in zip(*(b.column(c).to_pylist() for c in ("doc", "id", "ids"))):
                if d != doc:
                    if doc is not None:
                        names.append(name)
                        parts.append(b"".join(held))
                        size += len(parts[-1])
                        if size > 8 * BLOCK:
                            yield put(names, parts, id_type)
                            names, parts, size = [], [], 0
                    doc, name, held = d, i, []
                held.append(x)
            if names:
                yield put(names, parts, id_type)
        if doc is not None:
            yield put([name], [b"".join(held)], id_type)

    return work


def _broadcast_vocabulary(spark: SparkSession, directory: str, name: str):
    """The vocabulary file goes to every executor: about 1 MB whatever the corpus is."""
    return spark.sparkContext.broadcast(vocabulary_bytes(directory, name))


def _cut(df: DataFrame, id_col: str, text_col: str, directory: str, name: str):
    """The pieces of all texts, the schema of what they keep to the end, the vocabulary and the type code of ids."""
    vocabulary = _broadcast_vocabulary(df.sparkSession, directory, name)
    code = "H" if vocabulary.value.count(b"\n") < 1 << 16 else "I"
    # The row's own number stands for the row; ids need be neither unique nor present.
    numbered = df.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    piece = T.StructType([T.StructField("doc", T.LongType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("seq", T.IntegerType())])
    chunk = T.StructType([*piece, *fields("digest binary, salt int, body string, ids binary")])
    return numbered.mapInArrow(_chunk(vocabulary, code), chunk), piece, vocabulary, code


def chunk_reuse(df: DataFrame, id_col: str, text_col: str, directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """One row: ``joints``, ``chunks`` and their bytes, ``encodings`` of chunks and their bytes: what sharing saves.

    Null and empty texts count as nothing; an empty table has 0 everywhere.
    """
    cut, *_ = _cut(df, id_col, text_col, directory, name)
    joint = F.col("ids").isNotNull()
    per = cut.groupBy("digest", joint.alias("joint")).agg(F.count_if(joint & (F.octet_length("ids") > 0)).alias("joints"), F.count_if(~joint).alias("n"), F.max(F.octet_length("body")).alias("size"), F.count_distinct(F.when(~joint, F.col("salt"))).alias("k"))
    sums = {"joints": F.sum("joints"), "chunks": F.sum("n"), "chunk_bytes": F.sum(F.col("n") * F.col("size")), "encodings": F.sum("k"), "encoded_bytes": F.sum(F.col("k") * F.col("size"))}
    return per.agg(*[F.coalesce(c, F.lit(0).cast("long")).alias(a) for a, c in sums.items()])


def encode_corpus(df: DataFrame, id_col: str, text_col: str, directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """``id_col, ids array<int>`` for every row, equal to encoding each whole text by itself, without special tokens.

    Null and empty texts have an empty list.  Strings that look like special tokens are plain
    text.  Rows are kept as they are: repeated or null ids give as many rows as they come in.

    1. Each text is cut where a rolling hash of the bytes before says so, so equal stretches
       of different documents are cut alike.  Around a cut that may fall inside a word, the
       joint between two sure word boundaries is encoded right there.
    2. Chunks go to a reducer by a 128-bit digest, and a chunk is encoded once there.  A task
       sends at most FIRST_TOGETHER occurrences of a chunk, and its text once, to the
       reducer that all tasks share for it; the further ones of a chunk in very many documents
       go to reducers of a few tasks each, which encode it once more, so none gets more
       than some hundred of them.
    3. The ids return to their documents and are joined in order.
    """
    cut, piece, vocabulary, code = _cut(df, id_col, text_col, directory, name)
    id_type = df.schema[id_col].dataType
    sent = cut.repartition("digest", "salt").sortWithinPartitions("digest", "salt", F.col("body").isNull())
    encoded = sent.mapInArrow(_encode_once(vocabulary, code), T.StructType([*piece, T.StructField("ids", T.BinaryType())]))
    lists = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    whole = encoded.repartition("doc").sortWithinPartitions("doc", "seq").mapInArrow(_assemble(code), lists)
    return whole.withColumnRenamed("id", id_col)


def _count(vocabulary):
    def work(batches):
        import pyarrow as pa

        enc = encoder(vocabulary.value)
        for b in batches:
            sizes = [len(ordinary(enc, t)) if t else 0 for t in b.column("text").to_pylist()]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "n_tokens", pa.array(sizes, pa.int64()))

    return work


def count_tokens(df: DataFrame, text_col: str, directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """The rows with ``n_tokens`` in place of the text; null and empty texts have 0.  Nothing is exchanged."""
    vocabulary = _broadcast_vocabulary(df.sparkSession, directory, name)
    others = [c for c in df.columns if c != text_col]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField("n_tokens", T.LongType())])
    return df.select(*[F.col(c) for c in others], F.col(text_col).cast("string").alias("text")).mapInArrow(_count(vocabulary), schema)
