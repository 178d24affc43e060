"""Conversation structure repair: cheapest edits to legal role order, by a dynamic programme with persistent audits.

Roles are read as their first characters; a repaired conversation reads ``(s?(ua)+)?``.  Edits are Keep (0), Rerole to
user or assistant (1), Delete (2; the only edit of blank and duplicate rows) and Insert of an empty user or assistant
row (5); a truncated row that stays costs 5 more.  The audit is the edits' initials in order; of the cheapest audits the
ASCII-least one counts.  Each state of the role grammar has one legal next user or assistant row, so an audit decides
every role by itself.

A conversation is a run of rows in a range-partitioned, sorted table.  Runs are cut into blocks of at most
``BLOCK_ROWS`` rows.  A block that may have rows before it is solved from every state of the grammar, and the blocks of
a conversation are then joined state by state, so that a conversation with a third of all rows is many blocks in many
tasks.  Two cheapest audits of the same rows are never proper prefixes of each other (the longer one holds
more insertions and costs more), so the least audit of the whole is made of least audits of its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import shared_table

SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATION = 0, 1, 2, 5, 5
#: States of the role grammar, by what was last read; a legal conversation ends in START or ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
#: Bounds of a block's memory: rows, and characters of the texts that may stay.  They change no result.
BLOCK_ROWS = 1_024
BLOCK_CHARS = 8 << 20
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Edit strings that share their prefixes: a node is a parent and the text added to it.  ``up[n][k]`` is the
    2^k-th ancestor of n, ``hash[n]`` a rolling hash of the whole string.  Node 0 is the empty string."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.text, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def extend(self, node: int, text: str) -> int:
        value = self.hash[node]
        for c in text:
            value = (value * BASE + ord(c)) % self.modulus
        jumps, k = [node], 0
        while k < len(self.up[jumps[k]]):
            jumps.append(self.up[jumps[k]][k])
            k += 1
        self.text.append(text)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(value)
        self.up.append(tuple(jumps))
        return len(self.text) - 1

    def lift(self, node: int, depth: int) -> int:
        """The ancestor of ``node`` at ``depth``."""
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def common(self, a: int, b: int) -> int:
        """Depth of the longest common prefix (in nodes): found by hashes, then verified text by text back to the
        node that both share; where a hash lied, the depth before the first difference."""
        x = self.lift(a, self.depth[b])
        y = self.lift(b, self.depth[a])
        if self.hash[x] != self.hash[y]:
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            x, y = self.up[x][0], self.up[y][0]
        depth = self.depth[x]
        while x != y:
            if self.text[x] != self.text[y]:
                depth = self.depth[x] - 1
            x, y = self.up[x][0], self.up[y][0]
        return depth

    def before(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` is less than that of ``b`` (a proper prefix is less)."""
        depth = self.common(a, b)
        left = right = ""
        for d in range(depth + 1, max(self.depth[a], self.depth[b]) + 1):
            left += self.text[self.lift(a, d)] if d <= self.depth[a] else ""
            right += self.text[self.lift(b, d)] if d <= self.depth[b] else ""
            shared = min(len(left), len(right))
            if left[:shared] != right[:shared]:
                return left < right
            left, right = left[shared:], right[shared:]
        return left < right

    def pieces(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.text[node])
            node = self.up[node][0]
        return out[::-1]


Best = tuple[int, int] | None  # cost and audit node


def least(audits: Audits, ways: Iterable[tuple[Best, int, str]]) -> Best:
    """The cheapest of (state before, added cost, added text), of equal ones that with the least audit."""
    ways = [(b[0] + cost, b[1], text) for b, cost, text in ways if b is not None]
    if not ways:
        return None
    cheapest = min(w[0] for w in ways)
    best = None
    for cost, node, text in ways:
        if cost == cheapest:
            node = audits.extend(node, text) if text else node
            best = node if best is None or audits.before(node, best) else best
    return cheapest, best


def with_insertions(audits: Audits, best: list[Best]) -> list[Best]:
    start, system, user, assistant = best
    user = least(audits, [(user, 0, ""), *((b, INSERT, "I") for b in (start, system, assistant))])
    assistant = least(audits, [(assistant, 0, ""), (user, INSERT, "I")])
    return [start, system, user, assistant]


def after_row(audits: Audits, best: list[Best], fault: int, initial: str) -> list[Best]:
    """States after one row.  An insertion directly before a deletion is never least (the deletion may come first)."""
    gone = [(b, DELETE, "D") for b in best]
    if fault in (BLANK, DUPLICATE):
        return [least(audits, [g]) for g in gone]
    stay = TRUNCATION if fault == TRUNCATED else 0
    start, system, user, assistant = with_insertions(audits, best)
    as_user = (stay + KEEP, "K") if initial == "u" else (stay + REROLE, "R")
    as_assistant = (stay + KEEP, "K") if initial == "a" else (stay + REROLE, "R")
    return [least(audits, [gone[START]]),
            least(audits, [gone[SYSTEM], *([(start, stay + KEEP, "K")] if initial == "s" else [])]),
            least(audits, [gone[USER], *((b, *as_user) for b in (start, system, assistant))]),
            least(audits, [gone[ASSISTANT], (user, *as_assistant)])]


def finished(audits: Audits, best: list[Best]) -> Best:
    """The best legal end, with insertions after the last row."""
    start, _, _, assistant = with_insertions(audits, best)
    return least(audits, [(start, 0, ""), (assistant, 0, "")])


def fault_of(text: str, repeated: bool) -> int:
    body = text.rstrip(SPACE)
    if not body.strip(SPACE):
        return BLANK
    if repeated:
        return DUPLICATE
    return SOUND if body[-1] in STOPS else TRUNCATED


def edits_of(piece: str, state: int, initials: Iterable[str]) -> tuple[list[str], int]:
    """The piece of an audit as one code a row, and the state after it: inserted roles as u and a, then K, D or the
    new role as U or A.  Insertions after the last row are a code of their own."""
    initials, edits, code = iter(initials), [], ""
    for letter in piece:
        if letter == "I":
            state = ASSISTANT if state == USER else USER
            code += "a" if state == ASSISTANT else "u"
            continue
        initial = next(initials)
        if letter == "R":
            state = ASSISTANT if state == USER else USER
            code += "A" if state == ASSISTANT else "U"
        else:
            code += letter
            if letter == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
        edits.append(code)
        code = ""
    return edits + ([code] if code else []), state


def repaired(edit: str, role: str | None = None, text: str | None = None) -> Iterator[str]:
    """The lines ``role:text`` that an edit code makes of a row."""
    for code in edit:
        if code in "ua":
            yield "user:" if code == "u" else "assistant:"
        elif code == "K":
            yield f"{role}:{text}"
        elif code in "UA":
            yield f"{'user' if code == 'U' else 'assistant'}:{text}"


class Digest:
    """SHA-256 of lines joined by newlines, fed one by one."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, lines: Iterable[str]):
        for line in lines:
            self.sha.update((("\n" if self.any else "") + line).encode("utf-8", "surrogatepass"))
            self.any = True


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


class Block:
    """Neighbouring rows of a conversation, solved from the given states of the grammar."""

    def __init__(self, starts: Iterable[int]):
        self.audits = {s: Audits() for s in starts}
        self.best = {s: [(0, 0) if t == s else None for t in range(4)] for s in starts}
        self.lines: list[tuple[str, str | None]] = []
        self.count = dict.fromkeys(COUNTS, 0)
        self.first = self.last = self.low = self.high = None
        self.chars = 0

    def add(self, turn, role: str, text: str, repeated: bool):
        fault, initial, n = fault_of(text, repeated), role[:1], self.count
        n["rows"] += 1
        for key, value in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
            n[key] += fault == value
        n["illegal"] += self.last is not None and self.last + initial not in LEGAL
        if turn is not None and turn != self.high:
            n["turns"] += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        self.first, self.last = initial if self.first is None else self.first, initial
        for s, audits in self.audits.items():
            self.best[s] = after_row(audits, self.best[s], fault, initial)
        stays = fault not in (BLANK, DUPLICATE)
        self.lines.append((role, text if stays else None))
        self.chars += len(text) if stays else 0

    def full(self, most: int) -> bool:
        return len(self.lines) >= most or self.chars >= BLOCK_CHARS

    def table(self) -> list[dict]:
        return [{"start": s, "end": t, "cost": b[0], "audit": "".join(self.audits[s].pieces(b[1]))}
                for s, best in self.best.items() for t, b in enumerate(best) if b is not None]

    def solved(self) -> tuple[int, str, str]:
        """Cost, audit and digest of a conversation that is this block."""
        cost, node = finished(self.audits[START], self.best[START])
        audit = "".join(self.audits[START].pieces(node))
        edits, _ = edits_of(audit, START, (role[:1] for role, _ in self.lines))
        digest = Digest()
        for i, edit in enumerate(edits):
            digest.add(repaired(edit, *(self.lines[i] if i < len(self.lines) else ())))
        return cost, audit, digest.sha.hexdigest()


def _schema(conv: str, turn: str) -> str:
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return (f"kind string, conv {conv}, part int, seq int, pos int, {counts}, low {turn}, high {turn}, first string, "
            "last string, cost long, audit string, sha string, "
            "table array<struct<start:int,end:int,cost:long,audit:string>>, role string, text string, initials array<string>")


def _row(kind: str, conv, **values) -> dict:
    return {"kind": kind, "conv": conv, **values}


def _frames(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _block_rows(conv, block: Block, part: int, seq: int) -> Iterator[dict]:
    initials = [role[:1] for role, _ in block.lines]
    yield _row("block", conv, part=part, seq=seq, **block.count, low=block.low, high=block.high, first=block.first,
               last=block.last, table=block.table(), initials=initials)
    for pos, (role, text) in enumerate(block.lines):
        yield _row("line", conv, part=part, seq=seq, pos=pos, role=role, text=text)


def _scan(rows: Iterator[tuple], part: int, most: int) -> Iterator[dict]:
    """Sorted (conv, turn, role, text, copies, repeated) of one partition: a solved row for each conversation that
    lies within it, blocks with their lines for its first and last conversation and for cut ones."""
    conv, block, seq, opened, cut = None, None, 0, 0, False
    for key, turn, role, text, copies, again in rows:
        if block is None or key != conv:
            if block is not None:
                if cut or opened == 1:
                    yield from _block_rows(conv, block, part, seq)
                else:
                    cost, audit, sha = block.solved()
                    yield _row("solved", conv, **block.count, low=block.low, high=block.high, cost=cost, audit=audit, sha=sha)
            conv, seq, cut, opened = key, 0, False, opened + 1
            block = Block(range(4) if opened == 1 else (START,))
        for copy in range(copies):
            if block.full(most):
                yield from _block_rows(conv, block, part, seq)
                block, seq, cut = Block(range(4)), seq + 1, True
            block.add(turn, role, text, again or copy > 0)
    if block is not None:
        yield from _block_rows(conv, block, part, seq)


def _joined(blocks: Iterator[dict]) -> Iterator[dict]:
    """Blocks sorted by (conv, part, seq): one head row a conversation and the edits of each of its blocks."""
    def close(conv, audits, best, held, count, low, high):
        cost, node = finished(audits, best)
        pieces = audits.pieces(node)
        state = START
        for i, (part, seq, initials) in enumerate(held):
            piece = pieces[i] if i < len(pieces) else ""
            piece += "".join(pieces[len(held):]) if i == len(held) - 1 else ""
            edits, state = edits_of(piece, state, initials)
            yield {"kind": "plan", "conv": conv, "part": part, "seq": seq, "edits": edits}
        yield {"kind": "head", "conv": conv, **count, "low": low, "high": high, "cost": cost, "audit": "".join(pieces)}

    state = None
    for b in blocks:
        if state is None or state[0] != b["conv"]:
            if state is not None:
                yield from close(*state[:7])
            state = [b["conv"], Audits(), [(0, 0), None, None, None], [], dict.fromkeys(COUNTS, 0), None, None, None]
        if not b["rows"]:
            continue
        conv, audits, best, held, count, low, high, last = state
        ways = {t: [] for t in range(4)}
        for w in b["table"]:
            ways[w["end"]].append((best[w["start"]], w["cost"], w["audit"]))
        best = [least(audits, ways[t]) for t in range(4)]
        for c in COUNTS:
            count[c] += b[c]
        count["illegal"] += last is not None and last + b["first"] not in LEGAL
        count["turns"] -= high is not None and high == b["low"]
        held.append((b["part"], b["seq"], b["initials"]))
        state = [conv, audits, best, held, count, b["low"] if low is None else low,
                 high if b["high"] is None else b["high"], b["last"]]
    if state is not None:
        yield from close(*state[:7])


def _digests(rows: Iterator[tuple]) -> Iterator[dict]:
    """Sorted (conv, part, seq, pos, edits, role, text), a block's edits before its lines: a digest a conversation."""
    conv, digest, edits, n = None, None, [], 0
    for key, _, _, pos, plan, role, text in rows:
        if digest is None or key != conv or plan is not None:
            for edit in edits[n:]:  # insertions after the last row
                digest.add(repaired(edit))
            edits, n = [], 0
        if digest is None or key != conv:
            if digest is not None:
                yield {"conv": conv, "sha": digest.sha.hexdigest()}
            conv, digest = key, Digest()
        if plan is not None:
            edits = plan
        elif pos < len(edits):
            digest.add(repaired(edits[pos], role, text))
            n = pos + 1
    if digest is not None:
        for edit in edits[n:]:
            digest.add(repaired(edit))
        yield {"conv": conv, "sha": digest.sha.hexdigest()}


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", copies: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256``.

    Rows are ordered by turn (nulls first), then role, the text's first 32 characters and its digest.  ``copies`` says
    how often a row stands in its conversation (1 by default); a conversation whose rows all have 0 copies is returned
    with zeros, an empty audit and the digest of the empty text.  A null role or text is one space; a null id is a
    conversation of its own; repeated rows are adjacent and all but the first are duplicates; a row whose role is
    empty or starts with none of s, u and a can't be kept as it is.  Very long texts are cut into blocks by size.
    An empty table gives an empty result.  Other columns are ignored.

    The digest of a conversation that fills many blocks is fed in order by one task, line by line, as SHA-256 has
    no parallel form; nothing of it is held but the hash state.  The audit is one value, so its length is bound by
    what a row can hold.
    """
    spark = rows.sparkSession
    space = F.lit(" ")
    copies = F.lit(1) if copies is None else copies
    there = copies > 0
    rows = (rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), copies.cast("long").alias("copies"),
                        F.when(there, F.coalesce(F.col(role_col), space)).alias("role"),
                        F.when(there, F.coalesce(F.col(text_col), space)).alias("text"))
            .groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
            .withColumn("digest", F.sha2("text", 256)))
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    seen = (rows.where("copies > 0").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
            .agg(F.min(turn)["turn"].alias("seen"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            .withColumn("some", F.lit(True)))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    rows = rows.join(seen, same, "left").withColumn(
        "again", F.coalesce(F.col("some") & ~F.col("turn").eqNullSafe(F.col("seen")), F.lit(False)))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32), "digest"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    types = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    schema = _schema(types["conv"], types["turn"])
    arrow = _arrow_schema(spark, schema)

    def scan(batches):
        return _frames(_scan(_tuples(batches), TaskContext.get().partitionId(), block_rows), arrow)

    parts = shared_table(ordered.select("conv", "turn", "role", "text", "copies", "again").mapInArrow(scan, schema),
                         "dialogue", ("kind",))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    joint = (f"kind string, conv {types['conv']}, part int, seq int, edits array<string>, {counts}, "
             f"low {types['turn']}, high {types['turn']}, cost long, audit string")
    joint_arrow = _arrow_schema(spark, joint)

    def join(batches):
        return _frames(_joined(_records(batches)), joint_arrow)

    blocks = (parts.where("kind = 'block'").select("conv", "part", "seq", *COUNTS, "low", "high", "first", "last", "table", "initials")
              .repartition("conv").sortWithinPartitions("conv", "part", "seq"))
    joined = shared_table(blocks.mapInArrow(join, joint), "dialogue-joined", ("kind",))
    lines = (joined.where("kind = 'plan'").select("conv", "part", "seq", F.lit(-1).alias("pos"), "edits",
                                                  F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
             .unionByName(parts.where("kind = 'line'").select("conv", "part", "seq", "pos",
                                                              F.lit(None).cast("array<string>").alias("edits"), "role", "text"))
             .repartition("conv").sortWithinPartitions("conv", "part", "seq", "pos"))
    hashed = f"conv {types['conv']}, sha string"
    hashed_arrow = _arrow_schema(spark, hashed)

    def digests(batches):
        return _frames(_digests(_tuples(batches)), hashed_arrow)

    shas = lines.mapInArrow(digests, hashed).withColumnRenamed("conv", "key")
    heads = (joined.where("kind = 'head'").join(shas, F.col("conv").eqNullSafe(F.col("key")), "left")
             .withColumn("sha", F.coalesce("sha", F.sha2(F.lit(""), 256))))
    wanted = ["conv", *COUNTS, "low", "high", "cost", "audit", "sha"]
    done = parts.where("kind = 'solved'").select(*wanted).unionByName(heads.select(*wanted))
    gaps = F.coalesce(F.col("high").cast("long") - F.col("low").cast("long") + 1 - F.col("turns"), F.lit(0))
    return done.select(F.col("conv").alias(conv_col), gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated",
                       "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, Column]:
    """Conversations with seeded faults, and the column that says how often each row stands in its conversation:
    crc32 of ``conv:turn`` modulo 20 drops a row (0), empties it (1), takes its stops (2), repeats it (3) or makes it a
    user's (4).  Nulls are one space."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in (text_col, role_col))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)))
    code = F.crc32(name.cast("binary")) % 20
    out = rows.select(
        F.col(conv_col), F.col(turn_col), F.when(code == 4, F.lit("user")).otherwise(role).alias(role_col),
        F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.when(code == 0, F.lit(0)).when(code == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))
    return out, F.col("copies")


# ---------------------------------------------------------------- SQL
def crc32_sql(codes: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    byte = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(h, b))"
    return f"xor(list_reduce({codes}, lambda h, b: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _add(value: str, cost: str, letter: str) -> str:
    return f"lpad((substr({value}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({value}, 10) || '{letter}'"


def oracle() -> str:
    """The same costs and audits as strings ``cost in nine digits, audit``, whose order is that of the contract."""
    name = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    code = crc32_sql(f"list_transform(string_split({name}, ''), lambda c: ord(c)::BIGINT)")
    gone = [_add(v, "2", "D") for v in ("s0", "s1", "s2", "s3")]
    user = ", ".join(f"CASE WHEN keeps = 'u' THEN {_add(v, 'extra', 'K')} ELSE {_add(v, 'extra + 1', 'R')} END"
                     for v in ("s0", "s1", "i3"))
    assistant = f"CASE WHEN keeps = 'a' THEN {_add('i2', 'extra', 'K')} ELSE {_add('i2', 'extra + 1', 'R')} END"
    return f"""WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, ({code}) % 20 AS code FROM conversations),
damaged AS (
  SELECT coalesce(conv_id::VARCHAR, 'none') AS k, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, substr(text, 1, 32), sha256(text), copy) AS n
  FROM damaged),
kinds AS (
  SELECT *, lag(substr(role, 1, 1)) OVER (PARTITION BY k ORDER BY n) || substr(role, 1, 1) AS pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
         END AS fault
  FROM ranked),
counted AS (
  SELECT k, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM kinds GROUP BY k),
walk AS (
  SELECT k, 0::BIGINT AS n, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM counted
  UNION ALL
  SELECT k, n, {gone[0]},
         least({gone[1]}, CASE WHEN stays AND keeps = 's' THEN {_add('s0', 'extra', 'K')} END),
         CASE WHEN stays THEN least({gone[2]}, {user}) ELSE {gone[2]} END,
         CASE WHEN stays THEN least({gone[3]}, {assistant}) ELSE {gone[3]} END
  FROM (SELECT *, least(s3, {_add('i2', '5', 'I')}) AS i3
        FROM (SELECT w.k, r.n, s0, s1, s2, s3, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS stays,
                     CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra, substr(role, 1, 1) AS keeps,
                     least(s2, {_add('s0', '5', 'I')}, {_add('s1', '5', 'I')}, {_add('s3', '5', 'I')}) AS i2
              FROM walk w JOIN kinds r ON r.k = w.k AND r.n = w.n + 1))),
ended AS (
  SELECT w.k, least(s0, s3, {_add('least(s2, ' + _add('s0', '5', 'I') + ', ' + _add('s1', '5', 'I') + ')', '5', 'I')}) AS best
  FROM walk w JOIN counted c ON c.k = w.k AND c.n_rows = w.n),
replay AS (
  SELECT k, substr(best, 10) AS audit, 0 AS pos, 0::BIGINT AS n, '' AS state, []::VARCHAR[] AS lines FROM ended
  UNION ALL
  SELECT k, audit, pos + 1, n + CASE WHEN letter = 'I' THEN 0 ELSE 1 END,
         CASE letter WHEN 'D' THEN state WHEN 'K' THEN substr(role, 1, 1) ELSE substr(made, 1, 1) END,
         CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                     WHEN 'I' THEN list_append(lines, made || ':') ELSE list_append(lines, made || ':' || text) END
  FROM (SELECT p.*, r.role, r.text, substr(audit, pos + 1, 1) AS letter,
               CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END AS made
        FROM replay p LEFT JOIN kinds r ON r.k = p.k AND r.n = p.n + 1 WHERE pos < length(audit)))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS k FROM conversations) o
LEFT JOIN counted c ON c.k = o.k LEFT JOIN ended e ON e.k = o.k
LEFT JOIN replay p ON p.k = o.k AND p.pos = length(p.audit)"""
