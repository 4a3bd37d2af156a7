"""Chat formatting over a prefix tree.

Conversations that begin with the same turns share the nodes of those turns. A node is a run of turns that the same
conversations have, so a long conversation of its own is one node. It is named by a 128-bit digest of its path, so the
tree is built without comparing conversations: equal names merge in one aggregation. Sorting nodes by the
names along their paths is depth-first order, so one range sort and per-partition sums lay all trees out in a single
token stream in which each shared turn stands once. A node has its ids and span in the stream, the position id of its
first token (what precedes it in its own conversation), the spans of its ancestors, which are what its tokens may attend to
besides themselves, and the spans of its tokens that are learned. What is learned is tokenized apart from what stands
around it, so the loss mask covers whole tokens. Conversations are read back from ids alone.

The template marks turns with control strings; in texts and roles a backslash goes before each backslash and each
character that a control string can begin with, so no text can be read as a control string and all is reversible.

Defined results. Null role or text: empty; an assistant turn without text has no learned token. Turns are ordered by turn, then role and text; repeated rows stay. Null conv_id is a
conversation of its own. Other columns are ignored. Empty table: no row.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import in_parts, join_hot, store

#: The template: what stands before and after the escaped text of a turn.
MARKS = {"user": ("[INST] ", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", "[/SYS]")}
OTHER = ("[ROLE ", "]", "[/ROLE]")
LEARNED = "assistant"


def escape(text: str) -> str:
    return re.sub(r"[\\\[<\]]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def pieces_of(role: str, text: str) -> list[tuple[str, bool]]:
    """The formatted turn in pieces that are tokenized apart, and whether each is learned."""
    whole, loss = format_turn(role, text)
    return [(whole[: loss[0]], False), (whole[slice(*loss)], True), (whole[loss[1] :], False)] if loss else [(whole, False)]


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The formatted turn, and the span in it that the loss covers."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    body = escape(text)
    return before + body + after, (len(before), len(before) + len(body)) if role == LEARNED else None


#: An escaped pair, or a character that no control string begins with.
_PLAIN = r"(?:\\.|[^\\\[<\]])*+"
_TURN = re.compile(
    "|".join(rf"{re.escape(a)}(?P<{role}>{_PLAIN}){re.escape(b)}" for role, (a, b) in MARKS.items()) + rf"|{re.escape(OTHER[0])}(?P<role>{_PLAIN}){re.escape(OTHER[1])}(?P<text>{_PLAIN}){re.escape(OTHER[2])}",
    re.S,
)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["text"])) if kind == "text" else (kind, unescape(m[kind])))
        at = m.end()
    return out


_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a vocabulary, one for each Python worker."""
    if path not in _encodings:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def prefix_tree(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node, start, end, position, depth, conversations, ids, loss, attends) in a token stream, and leaves (conv_id,
    node) that name each conversation's last node. loss: spans of ids; attends: the ancestors' spans in stream order. Both
    are stored."""
    spark = conversations.sparkSession
    path = vocabulary or default_vocabulary()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def name(batches):
        for b in in_parts(batches):
            out: dict = {k: [] for k in ("conv_id", "at", "name", "parent", "role", "text")}
            for conv_id, own in zip(b.column("conv_id").to_pylist(), b.column("turns"), strict=True):
                parent = ""
                for k, t in enumerate(own.as_py()):
                    h = hashlib.blake2b(parent.encode(), digest_size=16)
                    h.update(f"{len(t['role'].encode())}:{t['role']}{t['text']}".encode())
                    for x, v in zip(out.values(), (conv_id, k, h.hexdigest(), parent, t["role"], t["text"]), strict=True):
                        x.append(v)
                    parent = h.hexdigest()
            kinds = (pa.int64(), pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    each = store(turns.mapInArrow(name, "conv_id long, at int, name string, parent string, role string, text string"), "turns")
    # A turn continues its parent's node if every conversation that has the parent has it too.
    counts = store(each.groupBy("name", "parent").agg(F.count("*").alias("n")), "counts")
    above = counts.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("children")).join(counts.select("name", F.col("n").alias("before")), "name")
    above = store(above.select(F.col("name").alias("parent"), "before", "children"), "above")
    heads = join_hot(counts, above, ["parent"], F.col("name"), "children", "left")
    heads = store(heads.select("name", F.col("n"), (~F.col("n").eqNullSafe(F.col("before"))).alias("head")), "heads")
    marked = join_hot(each.drop("parent"), heads, ["name"], F.coalesce("conv_id", F.lit(0)), "n")
    marked = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "head", "role", "text"))).alias("turns"))

    def grow(batches):
        for b in in_parts(batches):
            rows: list[list] = []
            for conv_id, own in zip(b.column("conv_id").to_pylist(), b.column("turns"), strict=True):
                names: list[str] = []
                for t in own.as_py():
                    if t["head"]:
                        names.append(t["name"])
                        rows.append([conv_id, False, len(names) - 1, t["name"], list(names), []])
                    for text, learned in pieces_of(t["role"], t["text"]):
                        last = rows[-1][5]
                        if last and not learned and not last[-1]["learned"]:
                            last[-1]["text"] += text
                        elif text:
                            last.append({"text": text, "learned": learned})
                if names:
                    rows[-1][1] = True
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            parts = pa.list_(pa.struct([("text", pa.string()), ("learned", pa.bool_())]))
            kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.string()), parts)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["conv_id", "last", "depth", "node", "path", "parts"])

    shape = "depth int, path array<string>"
    each = store(marked.mapInArrow(grow, "conv_id long, last boolean, depth int, node string, path array<string>, parts array<struct<text:string,learned:boolean>>"), "chains")
    nodes = each.groupBy("node").agg(F.count("*").alias("conversations"), *[F.first(c).alias(c) for c in ("depth", "path", "parts")])

    def encode(batches):
        for b in in_parts(batches):
            ids, loss = [], []
            for own in b.column("parts").to_pylist():
                line, spans = [], []
                for part in own:
                    found = encoding(path).encode_ordinary(part["text"])
                    if part["learned"]:
                        spans.append({"from": len(line), "to": len(line) + len(found)})
                    line += found
                ids.append(line)
                loss.append(spans)
            kept = {k: b.column(k) for k in ("node", "conversations", "depth", "path")}
            yield pa.RecordBatch.from_pydict(kept | {"ids": pa.array(ids, pa.list_(pa.int32())), "loss": pa.array(loss, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))})

    nodes = store(nodes.mapInArrow(encode, f"node string, conversations long, {shape}, ids array<int>, loss array<struct<from:int,to:int>>"), "nodes")
    # Depth-first order of all trees: a range sort, then sums inside and over partitions.
    order = nodes.select("node", F.size("ids").alias("n"), F.array_join("path", "").alias("key")).repartitionByRange("key").withColumn("part", F.spark_partition_id())
    order = store(order, "order")
    before = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    parts = order.groupBy("part").agg(F.sum("n").alias("n"))
    # One row a partition of the range sort.
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    spans = order.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(parts), "part")
    spans = store(spans.select("node", (F.col("offset") + F.col("before")).alias("start"), (F.col("offset") + F.col("before") + F.col("n")).alias("end")), "spans")
    # Ancestors of each node; a first turn may be above very many.
    up = nodes.select("node", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("level", "above"))
    weights = up.groupBy(F.col("above").alias("node")).count()
    weighed = store(spans.join(weights, "node").select(F.col("node").alias("above"), F.col("start").alias("s"), F.col("end").alias("e"), "count"), "above")
    attends = join_hot(up, weighed, ["above"], F.col("node"), "count").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("attends"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    out = nodes.drop("path").join(spans, "node").join(attends, "node", "left").withColumn("attends", F.coalesce("attends", none))
    out = out.withColumn("position", F.aggregate("attends", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start))
    return store(out, "tree"), each.filter("last").select("conv_id", "node")


def read_back(nodes: DataFrame, leaves: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, formatted, loss: array of texts): each conversation decoded from the ids of its leaf's own and attended
    spans, and from its learned ids."""
    path = vocabulary or default_vocabulary()
    used = store(leaves.groupBy("node").agg(F.count("*").alias("n")), "leaves")
    spans = used.join(nodes, "node").select("node", "n", F.concat("attends", F.array(F.struct("start", "end"))).alias("spans"))
    # Equal conversations share a leaf, so each distinct one is put together once.
    wanted = spans.select("node", F.explode("spans.start").alias("start"))
    many = store(wanted.groupBy("start").count().join(nodes.select("start", "ids", "loss"), "start"), "wanted")
    pieces = join_hot(wanted, many, ["start"], F.col("node"), "count")
    whole = pieces.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("start", "ids", "loss"))).alias("pieces"))

    def decode(batches):
        for b in in_parts(batches):
            text, learned = [], []
            for own in b.column("pieces").to_pylist():
                text.append(encoding(path).decode_bytes([i for p in own for i in p["ids"]]).decode())
                learned.append([encoding(path).decode_bytes(p["ids"][m["from"] : m["to"]]).decode() for p in own for m in p["loss"]])
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "formatted": pa.array(text, pa.string()), "loss": pa.array(learned, pa.list_(pa.string()))})

    whole = store(whole.mapInArrow(decode, "node string, formatted string, loss array<string>").join(used, "node"), "whole")
    return join_hot(leaves, whole, ["node"], F.monotonically_increasing_id(), "n").drop("node")


def op2(spark, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)

    def digest(batches):
        for b in in_parts(batches):
            out = []
            for formatted, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                turns = read_turns(formatted)
                learned = "".join(map(unescape, loss))
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(formatted)))
            n, turns, chars, loss, size = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict({
                "conv_id": b.column("conv_id"), "n_turns": pa.array(n, pa.int64()), "turns_sha256": pa.array(turns, pa.string()),
                "loss_chars": pa.array(chars, pa.int64()), "loss_sha256": pa.array(loss, pa.string()), "formatted_chars": pa.array(size, pa.int64()),
            })

    return read_back(*prefix_tree(table)).mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESCAPED = r"length(regexp_replace({0}, '([\\\[<\]])', '#\1', 'g'))"

#: What the turns say and what is learned of them, from the table itself; the lengths of the template's marks are its own.
OP2_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  m AS (SELECT *, CASE role {' '.join(f"WHEN '{k}' THEN {len(a) + len(b)}" for k, (a, b) in MARKS.items())} ELSE {sum(map(len, OTHER))} + {_ESCAPED.format('role')} END + {_ESCAPED.format('text')} AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
