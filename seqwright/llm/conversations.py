"""Conversation structure repair: the cheapest edits that give a conversation legal turns.

A conversation's rows, in order, are a path through four states (nothing yet, after system, after
user, after assistant); ``(s?(ua)+)?`` ends in the first or the last. A row is kept, given the role
that is due, or deleted; rows with empty text may be put in anywhere. Costs are a min-plus product of
4 x 4 matrices, one for each row, and the cost to go from every state is a vector that runs from the
last row to the first (Viterbi, backward).

Parallel form, by rank convergence. A conversation above ``CHUNK_ROWS`` rows or ``CHUNK_BYTES`` bytes is
cut into chunks at sampled order values. All chunks run at once, each from a speculative cost vector at
its right end. A fix-up pass hands every chunk the vector its right neighbour found and runs again those
whose vector differs from the one they used by more than a constant, until none does: a constant
added to a vector changes no choice, and after a few rows nearly every product has rank one, so one or
two passes are the rule (as many as chunks in the worst case). The vectors inside a chunk are then the true
costs to go up to a constant. Tracing goes forward: from a known state the least letter that
lies on a cheapest path is taken, which gives the ASCII-least audit of the cheapest ones. Each chunk is
traced from all four states, the states are stitched in chunk order (a few bytes a chunk), and the
trace that fits is applied to the rows.

All else is merged from chunks too: a text seen in an earlier chunk comes as a list of hashes with the
chunk; neighbouring roles and turns across a seam come from the chunks' first and last rows. Only the
digest of a repaired conversation is sequential by its definition (SHA-256 of the whole): a task streams the
chunks' texts in order through it and holds one chunk.

Conversations of one chunk, nearly all, are done in one pass over their sorted rows.

Defined cases: a null role or text is one space, a null conversation a group of its own, null turns come
first and do not count for gaps. Rows with the same turn are ordered by role, then text (bytes); equal
rows are interchangeable. A role counts by its first letter, an empty one fits nowhere. A conversation
without rows has zeros, an empty audit and the hash of nothing. A long text is one row like any
other; a chunk holds at least one row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seqwright.llm.common import SEPARATORS, written

CHUNK_ROWS = 16_384
CHUNK_BYTES = 16 << 20
SAMPLE = 16                # sampled order values for a chunk
MAX_BROADCAST = 1_000_000  # long conversations' rows that may be broadcast (checked)

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Codes of a row: role (0 system, 1 user, 2 assistant, 3 other), 4 if it must go, 8 if truncated.
MUST_GO, CUT_OFF = 4, 8
#: The state that an inserted row leads to, and its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BIG = 1 << 40


def _edits(code: int, state: int):
    """(letter, next state, cost) of the edits of a row in a state, in ASCII order, without inserts."""
    out = [("D", state, DELETE)]
    if not code & MUST_GO:
        late = TRUNCATED if code & CUT_OFF else 0
        role, due = code & 3, NEXT[state]
        if role == 0 and state == START:
            out.append(("K", SYSTEM, KEEP + late))
        elif (role, due) in ((1, USER), (2, ASSISTANT)):
            out.append(("K", due, KEEP + late))
        out.append(("R", due, REROLE + late))
    return out


EDITS = [[_edits(code, q) for q in range(4)] for code in range(16)]


def _matrix(code: int) -> list[list[int]]:
    """Cheapest cost from each state to each state over a row with inserts before it."""
    m = [[BIG] * 4 for _ in range(4)]
    for q in range(4):
        at, cost = q, 0
        for _ in range(4):   # the states that inserts reach, cheapest first
            for _, to, c in EDITS[code][at]:
                m[q][to] = min(m[q][to], cost + c)
            at, cost = NEXT[at], cost + INSERT
    return m


MATRICES = [_matrix(code) for code in range(16)]
#: Cost to go after the last row: inserts up to an end state.
LAST = [0, 2 * INSERT, INSERT, 0]


def backward(codes: bytes, right: list[int]) -> list[list[int]]:
    """Cost to go from every state before each row and after the last one."""
    out = [right] * (len(codes) + 1)
    v = right
    for i in range(len(codes) - 1, -1, -1):
        a, b, c, d = v
        v = [min(m[0] + a, m[1] + b, m[2] + c, m[3] + d) for m in MATRICES[codes[i]]]
        out[i] = v
    return out


def trace(codes: bytes, togo: list[list[int]], state: int, last: bool) -> tuple[str, int, int]:
    """(audit, state after it, cost) of the ASCII-least cheapest edits from a state on; ``last`` chunks end
    with the inserts that are due."""
    audit, cost = [], 0
    for i, code in enumerate(codes):
        after = togo[i + 1]
        while True:
            due = togo[i][state]
            letter, to, c = next(e for e in _options(code, state, togo[i], after) if e[3] == due)[:3]
            audit.append(letter)
            cost, state = cost + c, to
            if letter != "I":
                break
    if last:
        while state in (SYSTEM, USER):
            audit.append("I")
            cost, state = cost + INSERT, NEXT[state]
    return "".join(audit), state, cost


def _options(code: int, state: int, here: list[int], after: list[int]):
    """(letter, next state, cost, cost to go through it), in ASCII order."""
    edits = EDITS[code][state]
    yield *edits[0], edits[0][2] + after[edits[0][1]]
    yield "I", NEXT[state], INSERT, INSERT + here[NEXT[state]]
    for e in edits[1:]:
        yield *e, e[2] + after[e[1]]


def repaired_lines(audit: str, roles: list[str], texts: list[str], state: int):
    """The ``role:text`` lines that an audit makes of the rows, from a state on."""
    i = 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield f"{'user' if state == USER else 'assistant'}:"
            continue
        if letter == "K":
            state = SYSTEM if roles[i][:1] == "s" else NEXT[state]
            yield f"{roles[i]}:{texts[i]}"
        elif letter == "R":
            state = NEXT[state]
            yield f"{'user' if state == USER else 'assistant'}:{texts[i]}"
        i += 1


# ---------------------------------------------------------------- rows
def damaged(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (conv_id, turn, role, text) as the checks damage them, by
    crc32(``conv_id:turn``) % 20: 0 drops a row (it stays with ``gone``), 1 empties its text, 2 removes
    ``.!?``, 3 repeats it, 4 makes its role user."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), blank))) % 20
    out = df.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", blank).alias("role"),
                    F.coalesce("text", blank).alias("text"), kind.alias("kind"))
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    out = out.withColumn("text", F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


def _flags(rows: DataFrame) -> DataFrame:
    """Adds ``code`` (role, must go if blank, truncated), ``blank`` and ``h`` (16 bytes of role and text)."""
    trimmed = F.rtrim(F.col("text"), F.lit(SEPARATORS))
    first = F.col("role").startswith
    role = F.when(first("s"), 0).when(first("u"), 1).when(first("a"), 2).otherwise(3)
    blank = trimmed == ""
    cut = ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    h = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return rows.withColumn("code", (role + F.when(blank, MUST_GO).when(cut, CUT_OFF).otherwise(0)).cast("int")).withColumn("h", h)


def _null_key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("~"))


# ---------------------------------------------------------------- chunks of sorted rows
class _Chunk:
    """The rows of one chunk in order: what the repair and the counts need of them."""

    __slots__ = ("key", "codes", "roles", "texts", "seen", "turns", "blank", "duplicate", "truncated")

    def __init__(self, key):
        self.key, self.codes, self.roles, self.texts = key, bytearray(), [], []
        self.seen, self.turns = set(), []
        self.blank = self.duplicate = self.truncated = 0

    def add(self, code: int, h: bytes, turn, role: str, text: str | None) -> None:
        again = h in self.seen
        self.seen.add(h)
        if code & MUST_GO:
            self.blank += 1
        elif again:
            self.duplicate += 1
            code = (code & 3) | MUST_GO
        elif code & CUT_OFF:
            self.truncated += 1
        self.codes.append(code)
        self.roles.append(role)
        self.texts.append(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def illegal(self) -> int:
        i = [r[:1] for r in self.roles]
        return sum(a + b not in ("su", "ua", "au") for a, b in zip(i, i[1:]))


def _chunks(batches, n_keys: int):
    """_Chunk after _Chunk of batches sorted by their first ``n_keys`` columns; after the keys come
    seen (a hash of an earlier chunk, no row), gone, code, h, turn, role, text."""
    open_ = None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for key, seen, gone, code, h, turn, role, text in zip(zip(*cols[:n_keys]), *cols[n_keys:]):
            if open_ is None or open_.key != key:
                if open_ is not None:
                    yield open_
                open_ = _Chunk(key)
            if seen:
                open_.seen.add(h)
            elif not gone:
                open_.add(code, h, turn, role, text)
    if open_ is not None:
        yield open_


RESULT = ("conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")
_LONGS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _whole(id_type: pa.DataType):
    """Conversations of one chunk, from their sorted rows."""

    def run(batches):
        held = []

        def out():
            cols = list(zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]], *[pa.array(c, pa.string()) for c in cols[7:]]],
                names=["conv_id", *_LONGS, "audit", "repaired_sha256"])

        for c in _chunks(batches, 1):
            codes = bytes(c.codes)
            audit, _, cost = trace(codes, backward(codes, LAST), START, True) if codes else ("", START, 0)
            digest = hashlib.sha256("\n".join(repaired_lines(audit, c.roles, c.texts, START)).encode("utf-8", "surrogatepass"))
            gaps = c.turns[-1] - c.turns[0] + 1 - len(c.turns) if c.turns else 0
            held.append((c.key[0], gaps, c.blank, c.duplicate, c.truncated, c.illegal(), cost, audit, digest.hexdigest()))
            if len(held) >= 4096:
                yield out()
                held = []
        if held:
            yield out()

    return run


_ROW = ["seen", "gone", "code", "h", "turn", "role", "text"]
_ORDER = ["turn", "role", "text", "copy"]


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def repaired(rows: DataFrame, chunk_rows: int | None = None, chunk_bytes: int | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, gone, copy): gaps, counts of faults and of
    illegal neighbours, cost, audit and digest of the repaired text."""
    chunk_rows, chunk_bytes = chunk_rows or CHUNK_ROWS, chunk_bytes or CHUNK_BYTES
    size = F.sum(F.octet_length("text").cast("bigint")).alias("bytes")
    long_ = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"), size)
    parts = F.greatest(F.ceil(F.col("rows") / chunk_rows), F.ceil(F.col("bytes") / chunk_bytes))
    long_ = long_.select("conv_id", "rows", parts.cast("bigint").alias("parts")).where(F.col("parts") > 1)
    long_ = written(long_, "long-conversations")
    many = long_.agg(F.count(F.lit(1)).alias("n"), F.sum("parts").alias("parts")).first()
    short = rows
    if many["n"]:
        small = many["n"] <= MAX_BROADCAST
        other = long_.select(F.col("conv_id").alias("_c"))
        short = rows.join(F.broadcast(other) if small else other, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    key = _null_key("conv_id")
    got = _flags(short).withColumn("seen", F.lit(False))
    got = got.repartition(key).sortWithinPartitions(key, "conv_id", *_ORDER).select("conv_id", *_ROW)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    schema = RESULT.format(id=id_type)
    out = got.mapInArrow(_whole(_arrow_type(rows)), schema)
    if many["n"]:
        cut = _cut(rows, long_, many, small)
        out = out.unionByName(_long(cut, schema, _arrow_type(rows)))
    return out


# ---------------------------------------------------------------- long conversations
def _cut(rows: DataFrame, long_: DataFrame, many, small: bool) -> DataFrame:
    """The rows of long conversations with their chunk: the number of cut values at or below the row's order
    value. Cuts are every ``SAMPLE``-th of a hashed sample of the conversation's rows; equal rows are told apart by
    their number in the scan, so a conversation of one repeated row is cut like any other."""
    hint = F.broadcast if small else (lambda d: d)
    side = long_.select(F.col("conv_id").alias("_c"), "rows", "parts")
    own = rows.join(hint(side), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = written(own.withColumn("nr", F.monotonically_increasing_id()), "long-rows")
    rank = F.struct(*[F.col(c) for c in (*_ORDER, "nr")])
    share = F.least(F.lit(1.0), F.col("parts") * SAMPLE / F.col("rows"))
    drawn = own.where(F.pmod(F.xxhash64("nr"), F.lit(1 << 20)) < share * (1 << 20))
    cuts = drawn.groupBy("conv_id").agg(F.array_sort(F.collect_list(rank)).alias("s"))
    cuts = cuts.select(F.col("conv_id").alias("_c"), F.expr(f"filter(s, (x, i) -> i % {SAMPLE} = {SAMPLE - 1})").alias("_cuts"))
    cuts = written(cuts, "long-cuts")
    few = many["parts"] * SAMPLE <= MAX_BROADCAST
    own = own.join(F.broadcast(cuts) if few else cuts, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    own = own.withColumn("_o", rank)
    steps = int(many["parts"] * SAMPLE + 1).bit_length() + 1
    find = F.expr(f"""aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', size(_cuts)),
        (a, i) -> if(a.lo < a.hi,
            if(get(_cuts, (a.lo + a.hi) div 2) <= _o,
               named_struct('lo', cast((a.lo + a.hi) div 2 as int) + 1, 'hi', a.hi),
               named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int))), a), a -> a.lo)""")
    chunk = F.when(F.size(F.coalesce("_cuts", F.array())) > 0, find).otherwise(F.lit(0)).cast("int")
    return written(_flags(own.withColumn("chunk", chunk)).drop("_cuts", "_o", "rows", "parts"), "long-chunks")


def _seen_before(cut: DataFrame) -> DataFrame:
    """(conv_id, chunk, h) of the role and text hashes a chunk has that stand in an earlier chunk too."""
    per = cut.where(~F.col("gone")).select("conv_id", "chunk", "h").distinct()
    first = per.groupBy(F.col("conv_id").alias("_c"), F.col("h").alias("_h")).agg(
        F.min("chunk").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # one row a chunk and hash at most, so even a text of every row has few rows here
    return per.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h") == F.col("_h")) & (F.col("chunk") > F.col("first"))) \
        .select("conv_id", "chunk", "h")


def _summaries(id_type: pa.DataType):
    """One row per chunk: its codes and what its neighbours need of it."""
    names = ["conv_id", "chunk", "codes", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail"]

    def run(batches):
        for c in _chunks(batches, 2):
            t = c.turns or [None]
            yield pa.RecordBatch.from_arrays([
                pa.array([c.key[0]], id_type), pa.array([c.key[1]], pa.int32()), pa.array([bytes(c.codes)], pa.binary()),
                *[pa.array([v], pa.int64()) for v in (c.blank, c.duplicate, c.truncated, c.illegal(), len(c.turns), t[0], t[-1])],
                pa.array([c.roles[0][:1] if c.roles else None], pa.string()),
                pa.array([c.roles[-1][:1] if c.roles else None], pa.string())], names=names)

    return run


def _speculate(batches):
    """Each chunk from a speculative vector (the true one where it is the last): right, left."""
    for b in batches:
        codes, last = b.column("codes").to_pylist(), b.column("is_last").to_pylist()
        right = [LAST if x else [0, 0, 0, 0] for x in last]
        left = [backward(c, r)[0] for c, r in zip(codes, right)]
        yield _vectors(b, right, left, [True] * len(codes))


def _vectors(b, right, left, ran):
    four = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("chunk"), b.column("next"), pa.array(right, four),
                                       pa.array(left, four), pa.array(ran, pa.bool_())],
                                      names=["conv_id", "chunk", "next", "right", "left", "ran"])


def _again(batches):
    """A fix-up pass over the chunks whose neighbour's vector is not theirs plus a constant."""
    for b in batches:
        left = [backward(c, r)[0] for c, r in zip(b.column("codes").to_pylist(), b.column("right").to_pylist())]
        yield _vectors(b, b.column("right").to_pylist(), left, [True] * len(left))


def _differs(a: str, b: str) -> Column:
    """True where the vectors differ by more than a constant."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.array_max(d) != F.array_min(d)


def converged_vectors(chunks: DataFrame, schema_id: str) -> tuple[DataFrame, int]:
    """(conv_id, chunk, next, right, left) after the fix-up passes, and their number. ``chunks`` has conv_id,
    chunk, next (the next chunk, null for the last) and codes."""
    schema = f"conv_id {schema_id}, chunk int, next int, right array<bigint>, left array<bigint>, ran boolean"
    v = written(chunks.withColumn("is_last", F.col("next").isNull()).mapInArrow(_speculate, schema), "vectors")
    passes = 0
    while True:
        n = v.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_n"), F.col("left").alias("_right"))
        j = v.join(n, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("next") == F.col("_n")), "left").drop("_c", "_n")
        stale = F.col("_right").isNotNull() & _differs("right", "_right")
        j = written(j.withColumn("stale", stale), "neighbours")
        if not j.where("stale").limit(1).count():
            return v, passes
        passes += 1
        todo = j.where("stale").select("conv_id", "chunk", "next", F.col("_right").alias("right"))
        codes = chunks.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "codes")
        todo = todo.join(codes, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).drop("_c", "_k")
        rest = j.where(~F.col("stale")).select("conv_id", "chunk", "next", "right", "left", F.lit(False).alias("ran"))
        v = written(todo.mapInArrow(_again, schema).unionByName(rest), "vectors")


def _exits(batches):
    """The state each chunk leaves in, for each state it may be entered in."""
    for b in batches:
        ends = []
        for codes, right, nxt in zip(*(b.column(c).to_pylist() for c in ("codes", "right", "next"))):
            togo = backward(codes, right)
            ends.append([trace(codes, togo, q, nxt is None)[1] for q in range(4)])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("chunk"), pa.array(ends, pa.list_(pa.int32()))],
                                         names=["conv_id", "chunk", "ends"])


def _entries(batches):
    """The state each chunk is entered in; batches come sorted by conversation and chunk."""
    key, state = None, START
    for b in batches:
        entry = []
        for conv, chunk, ends in zip(*(c.to_pylist() for c in b.columns)):
            if key is None or key[0] != conv:
                key, state = (conv,), START
            entry.append(state)
            state = ends[state]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(entry, pa.int32())], names=["conv_id", "chunk", "entry"])


def _applied(id_type: pa.DataType):
    """Audit, cost and repaired lines of each chunk; its meta row (codes, right, entry, last) comes first."""

    def run(batches):
        meta, roles, texts, key = None, [], [], None

        def done():
            codes, right, entry, last = meta
            audit, _, cost = trace(codes, backward(codes, right), entry, last)
            body = "\n".join(repaired_lines(audit, roles, texts, entry)).encode("utf-8", "surrogatepass")
            some = any(a != "D" for a in audit)
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]], id_type), pa.array([key[1]], pa.int32()), pa.array([audit], pa.string()), pa.array([cost], pa.int64()),
                pa.array([body if some else None], pa.binary())], names=["conv_id", "chunk", "audit", "cost", "body"])

        for b in batches:
            for conv, chunk, is_row, gone, role, text, codes, right, entry, last in zip(*(c.to_pylist() for c in b.columns)):
                if key != (conv, chunk) or meta is None:
                    if meta is not None:
                        yield done()
                    key, roles, texts, meta = (conv, chunk), [], [], (codes, right, entry, last)
                elif not gone:
                    roles.append(role)
                    texts.append(text)
        if meta is not None:
            yield done()

    return run


def _joined(id_type: pa.DataType):
    """Audit, cost and digest of whole conversations from their chunks in order."""

    def run(batches):
        key, audit, cost, sha, some = None, [], 0, None, False

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], id_type), pa.array(["".join(audit)], pa.string()),
                                               pa.array([cost], pa.int64()), pa.array([sha.hexdigest()], pa.string())],
                                              names=["conv_id", "audit", "cost", "repaired_sha256"])

        for b in batches:
            for conv, a, c, body in zip(*(x.to_pylist() for x in b.columns)):
                if key is None or key[0] != conv:
                    if key is not None:
                        yield done()
                    key, audit, cost, sha, some = (conv,), [], 0, hashlib.sha256(), False
                audit.append(a)
                cost += c
                if body is not None:
                    sha.update(b"\n" + body if some else body)
                    some = True
        if key is not None:
            yield done()

    return run


def _long(cut: DataFrame, schema: str, id_type: pa.DataType) -> DataFrame:
    sid = cut.schema["conv_id"].dataType.simpleString()
    key = _null_key("conv_id")
    none = F.lit(None)
    rows = cut.select("conv_id", "chunk", F.lit(False).alias("seen"), "gone", "code", "h", "turn", "role", "text", "copy", "nr")
    seen = _seen_before(cut).select("conv_id", "chunk", F.lit(True).alias("seen"), F.lit(False).alias("gone"), none.cast("int").alias("code"),
                                    "h", none.cast("bigint").alias("turn"), none.cast("string").alias("role"),
                                    none.cast("string").alias("text"), none.cast("int").alias("copy"), none.cast("bigint").alias("nr"))
    both = rows.unionByName(seen).repartition(key, "chunk").sortWithinPartitions(
        key, "conv_id", "chunk", F.col("seen").desc(), *_ORDER, "nr").select("conv_id", "chunk", *_ROW)
    chunks = both.mapInArrow(_summaries(id_type), f"conv_id {sid}, chunk int, codes binary, blank bigint, duplicate bigint, truncated bigint, "
                             "illegal bigint, turns bigint, low bigint, high bigint, head string, tail string")
    chunks = written(chunks, "chunk-summaries")
    # narrow windows over chunks: what stands on both sides of a seam
    order = Window.partitionBy("conv_id").orderBy("chunk")
    links = written(chunks.select("conv_id", "chunk", F.lead("chunk").over(order).alias("next")), "chunk-links")
    chunks = chunks.join(links.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "next"),
                         F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).drop("_c", "_k")
    chunks = written(chunks, "chunks")

    v, _ = converged_vectors(chunks.select("conv_id", "chunk", "next", "codes"), sid)
    vc = v.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "right")
    solved = chunks.select("conv_id", "chunk", "next", "codes").join(
        vc, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).drop("_c", "_k")
    ends = written(solved.mapInArrow(_exits, f"conv_id {sid}, chunk int, ends array<int>"), "chunk-exits")
    entry = ends.repartition(key).sortWithinPartitions(key, "conv_id", "chunk").mapInArrow(_entries, f"conv_id {sid}, chunk int, entry int")
    entry = entry.toDF("_c", "_k", "entry")
    meta = solved.join(entry, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).drop("_c", "_k")

    meta = meta.select("conv_id", "chunk", F.lit(False).alias("is_row"), F.lit(False).alias("gone"), none.cast("string").alias("role"),
                       none.cast("string").alias("text"), "codes", "right", "entry", F.col("next").isNull().alias("last"),
                       none.cast("bigint").alias("turn"), none.cast("int").alias("copy"), none.cast("bigint").alias("nr"))
    body = cut.select("conv_id", "chunk", F.lit(True).alias("is_row"), "gone", "role", "text", none.cast("binary").alias("codes"),
                      none.cast("array<bigint>").alias("right"), none.cast("int").alias("entry"), none.cast("boolean").alias("last"),
                      "turn", "copy", "nr")
    pieces = meta.unionByName(body).repartition(key, "chunk").sortWithinPartitions(
        key, "conv_id", "chunk", "is_row", *_ORDER, "nr").select(
        "conv_id", "chunk", "is_row", "gone", "role", "text", "codes", "right", "entry", "last")
    pieces = pieces.mapInArrow(_applied(id_type), f"conv_id {sid}, chunk int, audit string, cost bigint, body binary")
    whole = pieces.repartition(key).sortWithinPartitions(key, "conv_id", "chunk").select("conv_id", "audit", "cost", "body").mapInArrow(
        _joined(id_type), f"conv_id {sid}, audit string, cost bigint, repaired_sha256 string")

    counts = chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")],
                                           F.min("low").alias("low"), F.max("high").alias("high"))
    pair = F.concat(F.lag("tail").over(order), F.col("head"))
    seams = chunks.where(F.length("codes") > 0).select("conv_id", (~pair.isin("su", "ua", "au")).cast("bigint").alias("bad"))
    turns = chunks.where(F.col("turns") > 0).select("conv_id", (F.lag("high").over(order) == F.col("low")).cast("bigint").alias("same"))
    for extra, c in ((seams, "bad"), (turns, "same")):
        extra = extra.groupBy(F.col("conv_id").alias("_c")).agg(F.sum(c).alias(c))
        counts = counts.join(extra, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    zero = F.lit(0).cast("bigint")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns") + F.coalesce("same", zero), zero)
    counts = counts.select(F.col("conv_id").alias("_c"), gaps.alias("gaps"), "blank", "duplicate", "truncated",
                           (F.col("illegal") + F.coalesce("bad", zero)).alias("illegal"))
    out = whole.join(counts, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return out.select("conv_id", *_LONGS, "audit", "repaired_sha256")
