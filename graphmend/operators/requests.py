"""Resolver request records (chat completions, embeddings) as JSON lines.

Requests are DataFrame rows whose ``request`` column is the JSON text of one
line; writing them is ``write.text`` partitioned by shard, so files are
produced by the executors, never assembled on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmend.functions.text import _c

CHAT_URL = "/v1/chat/completions"  # fixed value: batch endpoint of chat requests
EMBED_URL = "/v1/embeddings"  # fixed value: batch endpoint of embedding requests
CHAT_MODEL = "o3-mini"
EMBED_MODEL = "text-embedding-ada-002"
REASONING = {"reasoning_effort": "high"}

# Short task statements; deployments pass their own full instructions.
SUBCLUSTER_PROMPT = (
    "Group the entries of the given block that name the same thing. Return a JSON object mapping the block id "
    "to a list of groups; wrap the one representative of every group in **."
)
EDGE_PROMPT = (
    "Group relationship signatures '[source type] relation [target type]' that mean the same relation between "
    "the same types. Return a JSON object mapping the block id to a list of groups; mark one representative per "
    "group with **."
)
TYPE_PROMPT = 'Map the input node type to the best parent among the candidates, or to itself. Answer {"map": "<parent>"}.'
JUDGE_PROMPT = (
    "Judge whether the proposed groups of the block are correct. Answer a JSON object mapping the block id to "
    '{"is_correct": "True" or "False", "user_prompt": the block, "clusters": corrected groups}.'
)


def _lit_value(v) -> Column:
    if isinstance(v, dict):
        return F.struct(*[_lit_value(x).alias(k) for k, x in v.items()])
    return F.lit(v)


def messages(*parts: tuple[str, Column | str]) -> Column:
    """array<struct<role, content>> from (role, text column or literal) pairs."""
    return F.array(*[
        F.struct(F.lit(role).alias("role"), (F.lit(c) if isinstance(c, str) else c).alias("content"))
        for role, c in parts
    ])


def completion_requests(
    df: DataFrame,
    id_col: str,
    user_col,
    system_prompt: str = SUBCLUSTER_PROMPT,
    model: str = CHAT_MODEL,
    options: dict | None = None,
    few_shot: list[str] = (),
    json_response: bool = True,
) -> DataFrame:
    """One chat request per row -> (custom_id, request JSON text).

    ``options`` (required, as in the batch writer it replaces) are merged into
    the body after the messages.
    """
    if options is None:
        raise ValueError("options are required (e.g. {'reasoning_effort': 'high'})")
    msgs = [("system", system_prompt)] + [("user", s) for s in few_shot] + [("user", _c(user_col))]
    body = [F.lit(model).alias("model")]
    if json_response:
        body.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    body.append(messages(*msgs).alias("messages"))
    body += [_lit_value(v).alias(k) for k, v in options.items()]
    req = F.struct(
        F.col(id_col).cast("string").alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(CHAT_URL).alias("url"),
        F.struct(*body).alias("body"),
    )
    return df.select(F.col(id_col).cast("string").alias("custom_id"), F.to_json(req).alias("request"))


def embedding_requests(df: DataFrame, id_col: str, text_col, model: str = EMBED_MODEL) -> DataFrame:
    req = F.struct(
        F.col(id_col).cast("string").alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(EMBED_URL).alias("url"),
        F.struct(F.lit(model).alias("model"), _c(text_col).alias("input")).alias("body"),
    )
    return df.select(F.col(id_col).cast("string").alias("custom_id"), F.to_json(req).alias("request"))


def block_payload(id_col, members_col) -> Column:
    """Compact ``{"<id>": [members]}`` text sent as the user message."""
    return F.to_json(F.create_map(_c(id_col).cast("string"), _c(members_col)))


def block_prompts(blocks: DataFrame, members: str = "ids_in_cluster") -> DataFrame:
    """``"<cluster_id>: ['m1', 'm2']"`` prompt text and its key (text before ':')."""
    from graphmend.operators.types import python_list_text

    text = F.concat(F.col("cluster_id").cast("string"), F.lit(": "), python_list_text(F.col(members)))
    return blocks.select("cluster_id", text.alias("text")).withColumn("key", F.substring_index("text", ":", 1))


def write_requests(sharded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSONL request files, one folder per shard (``shard_id=<n>``)."""
    sharded.select("shard_id", "request").write.mode(mode).partitionBy("shard_id").text(path)


def finetune_examples(df: DataFrame, system_prompt: str, user_col, assistant_col) -> DataFrame:
    """Chat fine-tune line: {"messages": [system, user, assistant]}."""
    msgs = messages(("system", system_prompt), ("user", _c(user_col)), ("assistant", _c(assistant_col)))
    keep = [c for c in df.columns if c not in (user_col, assistant_col)]
    return df.select(*keep, F.to_json(F.struct(msgs.alias("messages"))).alias("example"))


def conversation_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Ordered turns of each conversation -> one {"messages": [...]} line."""
    grouped = turns.groupBy(conv_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), F.col("role").alias("role"),
                                             F.col("text").alias("content")))).alias("_m")
    )
    msgs = F.transform("_m", lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content")))
    return grouped.select(conv_col, F.to_json(F.struct(msgs.alias("messages"))).alias("example"))


def _json_string(col) -> Column:
    esc = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def pretty_payload(id_col, groups_col) -> Column:
    """``{"<id>": [[...], ...]}`` indented by two spaces per level (second-pass format)."""
    def group(g):
        items = F.array_join(F.transform(g, lambda m: F.concat(F.lit("      "), _json_string(m))), ",\n")
        return F.when(F.size(g) == 0, F.lit("    []")).otherwise(F.concat(F.lit("    [\n"), items, F.lit("\n    ]")))
    gs = _c(groups_col)
    body = F.when(F.size(gs) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[\n"), F.array_join(F.transform(gs, group), ",\n"), F.lit("\n  ]"))
    )
    return F.concat(F.lit("{\n  "), _json_string(_c(id_col).cast("string")), F.lit(": "), body, F.lit("\n}"))


SECOND_PASS_GUIDE = (
    "Each input lists a block id and the groups a first pass produced. Return corrected groups for the block "
    "in the same JSON shape, with one representative per group wrapped in **."
)


def second_pass_requests(df: DataFrame, id_col: str, groups_col: str, options: dict | None = None) -> DataFrame:
    """Judge/correction requests: system, guidance, pretty-printed groups."""
    payload = pretty_payload(id_col, groups_col)
    return completion_requests(df, id_col, payload, system_prompt=JUDGE_PROMPT,
                               options=REASONING if options is None else options, few_shot=[SECOND_PASS_GUIDE])
