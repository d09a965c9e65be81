r"""Chat formatting as prefix trees.

Conversations that begin with the same turns share those turns: every distinct turn
after every distinct beginning is one node, and its tokens are emitted once.  A tree
holds its nodes' tokens depth-first, with the position id of each token (positions run
on from the conversation's first token).  Each node has its interval of tokens, its
parent, and how far it reaches: the tokens from its start up to its reach are those of
the node and of all below it, so a token may attend to exactly the nodes whose interval
[start, reach) it lies in, and to the trunk above its tree.  That says all ancestor
intervals in two numbers a node.  Loss spans cover the tokens of assistant texts only.

Template: ``[INST] user [/INST]``, ``<<SYS>>\nsystem\n<</SYS>>\n``, `` assistant </s>``
and ``[ROLE:name] other [/ROLE]``.  In texts a backslash is doubled and a control
string gets one behind its first character, so no text can hold a control string and
the original comes back exactly.  Marks and text are tokenised apart, and a
tokenizer's own special tokens are plain text where a text holds them.

Equal conversations collapse to one leaf, by an aggregate with map-side combine.  A
turn below which more than TREE distinct conversations, or TREE_TOKENS tokens of
several, lie is hot and belongs to the trunk: a row of its own, with its parent in the
trunk.  What is left of conversations below one hot turn is dealt by the next turn to
trees of about half those sizes, which name the hot turn as ``above``.  So a turn
stands once however many conversations share it, and no task holds more of them than a
tree does (or one conversation, if that is longer).

Defined cases: null text and null role are empty; turns order by turn, then role and
text, nulls first; repeated rows are turns of their own; a row without conv_id is a
conversation of its own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TASKS, grouped, parts, shared_dir, small, stage
from .tokens import decoder, encoder

#: Distinct conversations, and tokens of several, below a turn that is not hot.
TREE, TREE_TOKENS = 256, 1 << 22
#: What opens and closes a turn; fixed values.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n"), "assistant": (" ", " </s>")}
_CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE:|\[/ROLE\]")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[ROLE:(?P<name>.*?)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.DOTALL)
_TURN_KIND = pa.struct([("path", pa.binary()), ("position", pa.int64()), ("ids", pa.binary()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_TURN_SQL = "array<struct<path:binary,position:long,ids:binary,loss_start:long,loss_end:long>>"
_NODE_KIND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("reach", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_NODE_SQL = "array<struct<start:long,end:long,reach:long,position:long,parent:int,loss_start:long,loss_end:long>>"
_LEAF_KIND = pa.struct([("leaf", pa.binary()), ("node", pa.int32())])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _role(role: str) -> str:
    """A role's name inside its mark: no bracket can end it early."""
    return role.replace("%", "%25").replace("]", "%5D")


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """The turn: its opening mark, its text inside and its closing mark."""
    opening, closing = MARKS.get(role) or (f"[ROLE:{_role(escape(role))}] ", " [/ROLE]")
    return opening, escape(text), closing


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        if m["name"] is not None:
            out.append((unescape(m["name"].replace("%5D", "]").replace("%25", "%")), unescape(m["other"])))
        else:
            role = m.lastgroup
            out.append((role, unescape(m[role])))
        at = m.end()
    return out


def _encoded(turns, encode) -> list[dict]:
    """Each turn of a conversation: the name of the beginning that it ends, its first position, its ids and its loss span."""
    out, name, position = [], b"", 0
    for t in turns:
        role, text = (t["role"] or ""), (t["text"] or "")
        a, b = role.encode(), text.encode()
        name = hashlib.blake2b(b"%s%d:%s%d:%s" % (name, len(a), a, len(b), b), digest_size=16).digest()
        ids = [encode(part) for part in format_turn(role, text)]
        whole = np.concatenate(ids)
        loss = (len(ids[0]), len(ids[0]) + len(ids[1])) if role == "assistant" else (None, None)
        out.append({"path": name, "position": position, "ids": whole.astype("<u4").tobytes(), "loss_start": loss[0], "loss_end": loss[1]})
        position += len(whole)
    return out


def _named(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each conversation: conv_id, leaf (the name of the whole), tokens (how many), turns."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    rows = df.select("conv_id", turn)
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.union(rows.where("conv_id is null").select("conv_id", F.array("t")))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def name(batches):
        encode = encoder(tokenizer_path, True)
        for batch in batches:
            for at in range(batch.num_rows):  # one at a time: a conversation may be long
                turns = _encoded(batch.column("turns")[at].as_py(), encode)
                tokens = turns[-1]["position"] + len(turns[-1]["ids"]) // 4
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(at, 1), pa.array([turns[-1]["path"]]), pa.array([tokens], pa.int64()), pa.array([turns], pa.list_(_TURN_KIND))], ["conv_id", "leaf", "tokens", "turns"])

    return whole.mapInArrow(name, f"conv_id {dict(df.dtypes)['conv_id']}, leaf binary, tokens long, turns {_TURN_SQL}")


def _tree(conversations: list[tuple[bytes | None, list[dict]]]) -> dict:
    """One tree of (leaf, turns), depth-first with children in the order of their names."""
    children: dict[bytes | None, dict[bytes, dict]] = {}
    for _, turns in conversations:
        above = None
        for turn in turns:
            children.setdefault(above, {}).setdefault(turn["path"], turn)
            above = turn["path"]
    below = lambda path, parent: [(p, t, parent) for p, t in sorted(children.get(path, {}).items(), reverse=True, key=lambda c: c[0])]
    tokens, positions, nodes, index, at = [], [], [], {}, 0
    todo = below(None, -1)
    while todo:
        path, turn, parent = todo.pop()
        n, base, learned = len(turn["ids"]) // 4, turn["position"], turn["loss_start"] is not None
        index[path] = len(nodes)
        nodes.append({"start": at, "end": at + n, "reach": at + n, "position": base, "parent": parent, "loss_start": at + turn["loss_start"] if learned else None, "loss_end": at + turn["loss_end"] if learned else None})
        tokens.append(np.frombuffer(turn["ids"], "<i4"))
        positions.append(np.arange(base, base + n))
        at += n
        todo += below(path, index[path])
    for node in reversed(nodes):  # children stand behind their parents
        if node["parent"] >= 0:
            above = nodes[node["parent"]]
            above["reach"] = max(above["reach"], node["reach"])
    none = np.zeros(0, np.int64)
    return {"tokens": np.concatenate([none, *tokens]), "positions": np.concatenate([none, *positions]), "nodes": nodes,
            "leaves": [{"leaf": leaf, "node": index[turns[-1]["path"]]} for leaf, turns in conversations if leaf is not None]}


def _grow(rooted: DataFrame, n: int) -> DataFrame:
    """Trees of rows (tree, above, leaf, turns); above names the trunk's turn that a tree hangs on."""
    def grow(batches):
        for (key,), slices in grouped(batches, ["tree"]):
            rows = sorted((r for s in slices for r in s.to_pylist()), key=lambda r: r["leaf"] or b"")
            tree = _tree([(r["leaf"], r["turns"]) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([rows[0]["above"]], pa.binary()), pa.array([tree["tokens"]], pa.list_(pa.int32())), pa.array([tree["positions"]], pa.list_(pa.int64())), pa.array([tree["nodes"]], pa.list_(_NODE_KIND)), pa.array([tree["leaves"]], pa.list_(_LEAF_KIND))], ["tree", "above", "tokens", "positions", "nodes", "leaves"])

    return rooted.repartition(n, "tree").sortWithinPartitions("tree").mapInArrow(grow, f"tree binary, above binary, tokens array<int>, positions array<long>, nodes {_NODE_SQL}, leaves array<struct<leaf:binary,node:int>>")


def chat_trees(df: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """Trees (tree, above, tokens, positions, nodes, leaves) of conversations (conv_id, turn, role, text), and the places
    (conv_id, leaf, trunk, tree) of each conversation: its turns in the trunk from the first on, and the tree of the others, null if none is left."""
    shared_dir(df.sparkSession)
    named = stage(_named(df.select("conv_id", "turn", "role", "text"), tokenizer_path), "named")
    distinct = stage(named.groupBy("leaf").agg(F.any_value("tokens").alias("tokens"), F.any_value("turns").alias("turns")), "distinct")
    steps = distinct.select("leaf", "tokens", F.posexplode("turns.path").alias("depth", "path"))
    held = steps.groupBy("path").agg(F.count("*").alias("n"), F.sum("tokens").alias("w"), F.min(F.struct("leaf", "depth")).alias("holder"))
    hot = stage(held.where((F.col("n") > TREE) | ((F.col("n") > 1) & (F.col("w") > TREE_TOKENS))), "hot")
    tasks = min(parts(named), TASKS)
    cuts = steps.join(small(hot.select("path", F.greatest(F.ceil(F.col("n") * 2 / TREE), F.ceil(F.col("w") * 2 / TREE_TOKENS)).alias("groups"))), "path")
    cuts = cuts.groupBy("leaf").agg(F.max_by(F.struct("path", "groups"), "depth").alias("cut"), F.max("depth").alias("at"))
    rest = F.slice("turns", F.coalesce("at", F.lit(-1)) + 2, F.size("turns"))
    dealt = stage(distinct.join(cuts, "leaf", "left").select("leaf", "cut", F.slice("turns.path", 1, F.coalesce("at", F.lit(-1)) + 1).alias("trunk"), rest.alias("turns")), "dealt")
    root = F.get("turns", 0)["path"]
    tree = F.when(F.size("turns") > 0, F.coalesce(F.concat("cut.path", F.pmod(F.xxhash64(root), "cut.groups").cast("string").cast("binary")), root))
    dealt = dealt.withColumn("tree", tree)
    # the trunk: each turn that is shared by more than a tree holds, once
    holders = hot.groupBy(F.col("holder.leaf").alias("leaf")).agg(F.collect_list("holder.depth").alias("depths"))
    turn = F.get("turns", F.col("depth"))
    trunk = distinct.join(holders, "leaf").select("turns", F.explode("depths").alias("depth")).select(turn["path"].alias("tree"), F.when(F.col("depth") > 0, F.get("turns", F.col("depth") - 1)["path"]).alias("above"), F.lit(None).cast("binary").alias("leaf"), F.array(turn).alias("turns"))
    rooted = dealt.where("tree is not null").select("tree", F.col("cut.path").alias("above"), "leaf", "turns")
    return _grow(rooted.union(trunk), tasks), named.select("conv_id", "leaf").join(dealt.select("leaf", "trunk", "tree"), "leaf").select("conv_id", "leaf", "trunk", "tree")


def read_back(trees: DataFrame, places: DataFrame, tokenizer_path: str) -> DataFrame:
    """(leaf, turns, loss, formatted) of each distinct conversation, from ids, parents and loss spans alone."""
    kind = "leaf binary, at int, ids binary, loss array<struct<start:long,end:long>>"
    names = ["leaf", "at", "ids", "loss"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def segments(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, nodes = batch.column("tokens")[at].values.to_numpy().astype("<u4"), batch.column("nodes")[at].as_py()
                for leaf in batch.column("leaves")[at].as_py():
                    chain, node, size, loss = [], leaf["node"], 0, []
                    while node >= 0:
                        chain.append(nodes[node])
                        node = nodes[node]["parent"]
                    for n in reversed(chain):
                        if n["loss_start"] is not None:
                            loss.append({"start": size + n["loss_start"] - n["start"], "end": size + n["loss_end"] - n["start"]})
                        size += n["end"] - n["start"]
                    own = np.concatenate([ids[n["start"] : n["end"]] for n in reversed(chain)])
                    yield pa.RecordBatch.from_arrays([pa.array([leaf["leaf"]], pa.binary()), pa.array([1 << 30], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([loss], spans)], names)

    def single(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, node = batch.column("tokens")[at].values.to_numpy().astype("<u4"), batch.column("nodes")[at].as_py()[0]
                loss = [{"start": node["loss_start"], "end": node["loss_end"]}] if node["loss_start"] is not None else []
                yield pa.RecordBatch.from_arrays([batch.column("tree").slice(at, 1), pa.array([ids.tobytes()], pa.binary()), pa.array([loss], spans)], ["id", "ids", "loss"])

    def read(batches):
        decode = decoder(tokenizer_path)
        for batch in batches:
            for at in range(batch.num_rows):
                pieces, learned = [], []
                for part in batch.column("parts")[at].as_py():
                    ids = np.frombuffer(part["ids"], "<u4")
                    pieces.append(decode(ids.tolist()))
                    learned += [unescape(decode(ids[s["start"] : s["end"]].tolist()).decode()) for s in part["loss"]]
                formatted = b"".join(pieces).decode()
                turns = [{"role": r, "text": t} for r, t in parse(formatted)]
                yield pa.RecordBatch.from_arrays([batch.column("leaf").slice(at, 1), pa.array([turns], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(["".join(learned)]), pa.array([formatted])], ["leaf", "turns", "loss", "formatted"])

    trees = stage(trees, "trees")
    cold = trees.where(F.size("leaves") > 0).select("tokens", "nodes", "leaves").mapInArrow(segments, kind)
    above = places.select("leaf", "trunk").where(F.size("trunk") > 0).groupBy("leaf").agg(F.any_value("trunk").alias("trunk")).select("leaf", F.posexplode("trunk").alias("at", "id"))
    trunk = stage(trees.where(F.size("leaves") == 0).select("tree", "tokens", "nodes").mapInArrow(single, "id binary, ids binary, loss array<struct<start:long,end:long>>"), "trunk")
    parts_ = cold.union(above.join(small(trunk), "id").select(names)).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", "ids", "loss"))).alias("parts"))
    return parts_.mapInArrow(read, "leaf binary, turns array<struct<role:string,text:string>>, loss string, formatted string")


def op10_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    both, path = "</s>[INST] ok [/INST]", str(public_tokenizers.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    trees, places = chat_trees(rows, path)
    back = read_back(trees, places, path)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = back.select("leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    return places.select("conv_id", "leaf").join(digest, "leaf").drop("leaf")


SQL = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE:|\[/ROLE\])', '\1\\', 'g')) AS esc,
    CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 18 WHEN 'assistant' THEN 6 ELSE 16 + length(role) END AS marks FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(esc + marks) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id, own
"""
