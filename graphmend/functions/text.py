"""Column functions for identifiers, signatures, markers and payloads.

Every function here returns a built-in Column expression (codegen'd, no
Python in the row path).  Semantics follow the resolution scripts the
library replaces; quirks that matter for equal results are noted inline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the resolved data's conventions.
MARKER_CHARS = "*: "  # characters trimmed from both ends of an output member
REP_MARKER = "**"  # a representative member is wrapped in this marker
NULL_TEXT = "nan"  # text a missing value becomes inside a formatted string

GROUPS_TYPE = "array<array<string>>"
PAYLOAD_TYPE = "map<string,string>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_markers(col, chars: str = MARKER_CHARS) -> Column:
    """Trim a character *set* from both ends (like ``str.strip(chars)``)."""
    return F.btrim(_c(col), F.lit(chars))


def is_representative(col) -> Column:
    return F.contains(_c(col), F.lit(REP_MARKER))


def node_id(name, node_type) -> Column:
    """``name [type]``; null if either part is null."""
    return F.concat(_c(name), F.lit(" ["), _c(node_type), F.lit("]"))


def as_text(col, null_text: str = NULL_TEXT) -> Column:
    """String form of a value inside formatted text: null becomes ``nan``."""
    return F.coalesce(_c(col).cast("string"), F.lit(null_text))


def edge_signature(source_type, edge, target_type, null_text: str = NULL_TEXT, strip: bool = False) -> Column:
    """``[source type] edge [target type]`` (directional)."""
    e = strip_markers(edge) if strip else _c(edge)
    return F.concat(
        F.lit("["), as_text(source_type, null_text), F.lit("] "),
        as_text(e, null_text), F.lit(" ["), as_text(target_type, null_text), F.lit("]"),
    )


def embedding_input(id_col, definition, null_text: str = NULL_TEXT) -> Column:
    """Text sent to an embedder: ``{id} : {definition}``."""
    return F.concat(as_text(id_col, null_text), F.lit(" : "), as_text(definition, null_text))


# ---------------------------------------------------------------- signatures

def count_char(col, ch: str) -> Column:
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def signature_types(sig) -> Column:
    """Source and target type of a signature for group type checks.

    source = text before the first ``]`` after its first ``[``;
    target = third ``[``-segment up to its first ``]``.  Null fields when the
    text has too few brackets (the member is then ignored by the check).
    """
    s = _c(sig)
    head = F.substring_index(s, "]", 1)
    ok = (F.instr(head, "[") > 0) & (count_char(s, "[") >= 2)
    src = F.split_part(head, F.lit("["), F.lit(2))
    tgt = F.substring_index(F.split_part(s, F.lit("["), F.lit(3)), "]", 1)
    return F.when(ok, F.struct(src.alias("source"), tgt.alias("target")))


def signature_parts(sig) -> Column:
    """Split a (mapped) signature into source / edge / target for applying.

    source = first ``]``-segment minus its first char, target = third
    ``[``-segment minus its last char, edge = second ``]``-segment up to the
    next ``[``; each space-trimmed.  Null when brackets are missing.
    """
    s = _c(sig)
    ok = (count_char(s, "]") >= 1) & (count_char(s, "[") >= 2)
    src_seg = F.substring_index(s, "]", 1)
    tgt_seg = F.split_part(s, F.lit("["), F.lit(3))
    edge_seg = F.split_part(s, F.lit("]"), F.lit(2))
    src = F.btrim(F.substring(src_seg, 2, 1 << 30), F.lit(" "))
    tgt = F.btrim(F.substring(tgt_seg, F.lit(1), F.greatest(F.length(tgt_seg) - 1, F.lit(0))), F.lit(" "))
    edge = F.btrim(F.substring_index(edge_seg, "[", 1), F.lit(" "))
    return F.when(ok, F.struct(src.alias("source"), edge.alias("edge"), tgt.alias("target")))


# ------------------------------------------------------------------ payloads

def parse_object(text) -> Column:
    """JSON object text -> map; arrays, scalars, garbage, truncation -> null.

    ``from_json`` tolerates trailing text after a complete object, so a
    closing-brace check keeps the accept set close to a strict parser.
    """
    t = _c(text)
    m = F.from_json(t, PAYLOAD_TYPE, {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.when(F.rtrim(t).endswith(F.lit("}")), m)


def first_value(payload_map) -> Column:
    """First value of an object (key order as written)."""
    return F.get(F.map_values(_c(payload_map)), 0)


def _strict_list(text) -> Column:
    """Text that is one list literal and nothing else, as plain JSON text; else null.

    Single quotes are allowed; text after the closing bracket, a missing
    bracket and a trailing comma are not (a trailing comma is the one valid
    list literal that is refused: such a response goes to rerun).
    """
    t = F.btrim(_c(text))
    wrapped = F.map_values(F.from_json(F.concat(F.lit('{"k":'), t, F.lit("}")), PAYLOAD_TYPE))
    return F.when(t.startswith("[") & t.endswith("]") & (F.size(wrapped) == 1), F.get(wrapped, 0))


def _is_array(variant) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("ARRAY"), F.lit(False))


def is_list_member(member) -> Column:
    """Whether a group member was a list itself (kept as its JSON text)."""
    return _is_array(F.try_parse_json(_c(member)))


def leaf_members(members) -> Column:
    """All strings of a member array, lists nested to any depth flattened (C17).

    A list member is JSON text, so its strings are its string literals.
    """
    def leaves(m):
        literals = F.regexp_extract_all(m, F.lit(r'"(?:[^"\\]|\\.)*"'), F.lit(0))
        inner = F.from_json(F.concat(F.lit("["), F.array_join(literals, ","), F.lit("]")), "array<string>")
        return F.when(is_list_member(m), inner).otherwise(F.array(m))
    return F.flatten(F.transform(_c(members), leaves))


def parse_groups(text, lenient_flat: bool = True) -> Column:
    """List-literal text -> ``array<array<string>>`` (single quotes allowed).

    The text must be the list and nothing else.  A member that is a list
    again stays as its JSON text (see ``is_list_member``).  A string in place
    of a group is read the way a nested loop reads it: it becomes its list of
    characters (so it carries no marker and fails the representative check).
    Anything else -> null.
    """
    groups = F.try_variant_get(F.try_parse_json(_strict_list(text)), "$", "array<variant>")

    def members(g):
        return F.when(_is_array(g), F.transform(F.try_variant_get(g, "$", "array<variant>"),
                                                lambda m: F.try_variant_get(m, "$", "string")))

    def chars(g):
        return F.when(F.schema_of_variant(g) == "STRING", F.split(F.try_variant_get(g, "$", "string"), ""))

    read = F.transform(groups, lambda g: F.coalesce(members(g), chars(g)) if lenient_flat else members(g))
    return F.when(F.forall(read, lambda g: g.isNotNull()), read)


def safe_extract(text) -> Column:
    """Two-level extract: object -> first value -> list literal; else the raw value.

    null / blank -> null.  Returns ``array<array<string>>`` or null.
    """
    t = _c(text)
    blank = t.isNull() | (F.btrim(t) == "")
    val = first_value(F.from_json(t, PAYLOAD_TYPE))
    return F.when(~blank, parse_groups(F.coalesce(val, t)))


def flatten_members(groups) -> Column:
    return F.flatten(_c(groups))


def flatten_bracketed(members) -> Column:
    """Expand members that are themselves list literals (``'[a, b]'``)."""
    def expand(x):
        parsed = F.from_json(x, "array<string>")
        return F.when(F.btrim(x).rlike(r"^\[.*\]$") & parsed.isNotNull(), parsed).otherwise(F.array(x))
    return F.flatten(F.transform(_c(members), expand))


def multi_member_groups(groups) -> Column:
    return F.filter(_c(groups), lambda g: F.size(g) > 1)


def groups_have_representative(groups) -> Column:
    """Every group holds a marked member that is not a list (empty list of groups passes)."""
    return F.forall(_c(groups), lambda g: F.exists(g, lambda m: is_representative(m) & ~is_list_member(m)))


def groups_single_typed(groups) -> Column:
    """Each group has at most one source type and one target type."""
    def one_type(g):
        parsed = F.filter(F.transform(g, lambda m: signature_types(strip_markers(m))), lambda p: p.isNotNull())
        return (F.size(F.array_distinct(F.transform(parsed, lambda p: p["source"]))) <= 1) & (
            F.size(F.array_distinct(F.transform(parsed, lambda p: p["target"]))) <= 1
        )
    return F.forall(_c(groups), one_type)


def members_within(groups, block_members) -> Column:
    """Every output member (nested lists flattened, markers trimmed) is one of the block's members."""
    return F.forall(leaf_members(flatten_members(groups)), lambda m: F.array_contains(_c(block_members), strip_markers(m)))


def word_token_count(text) -> Column:
    """Token-count proxy: words plus single punctuation characters.

    Counted without building a token array: every word run becomes one
    character, whitespace is dropped, and the remaining length is the count.
    """
    t = F.coalesce(_c(text), F.lit(""))
    return F.length(F.regexp_replace(F.regexp_replace(t, r"\w+", "x"), r"\s", "")).cast("bigint")
