"""Scalar text functions as Column expressions: words, lines, shingles, identities, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
MIN_LITERAL = 8
UNIT = "\x1f"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: inside a lambda a plain expression would be worked out for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def fold_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(" "))


def line_array(text: Column) -> Column:
    """Lines with white space folded; blank lines dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), fold_space), lambda x: x != "")


def strip_line_comment(line: Column) -> Column:
    """A line up to // or #; line-local, block comments over several lines stay."""
    return F.btrim(F.regexp_replace(line, r"(//|#).*$", ""), F.lit(SPACE))


def norm_lines(text: Column) -> Column:
    """Folded, comment-free, non-blank lines."""
    return F.filter(F.transform(line_array(text), strip_line_comment), lambda x: x != "")


def norm_hash(text: Column) -> Column:
    """sha1 over the normal lines."""
    return F.sha1(F.array_join(norm_lines(text), "\n").cast("binary"))


def raw_hash(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")).cast("binary"))


def source_hash(text: Column, least: int = 12) -> Column:
    """sha1 over the words; null for texts of fewer than least words, so that these never match."""
    w = words(text)
    return F.when(F.size(w) >= least, F.sha1(F.array_join(w, " ").cast("binary")))


def shingles(tokens: Column, n: int = 4, least: int = 12) -> Column:
    """Runs of n tokens; none for fewer than least tokens."""

    def runs(t: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), UNIT))
        return F.when(F.size(t) < max(least, n), F.array().cast("array<string>")).otherwise(found)

    return let(tokens, runs)


def name_tokens(name: Column) -> Column:
    """Distinct lower-case parts of a name, cut at case changes and at anything but letters and digits."""
    cased = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(cased), r"[^a-z0-9]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column, both_empty: float = 0.5) -> Column:
    """Overlap of two sets of tokens; both_empty if neither has any, 0 if one has none."""
    shared, joined = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(joined == 0, F.lit(both_empty)).otherwise(shared / joined)


def mask_line(line: Column, keep: tuple[str, ...] = ()) -> Column:
    """Tokens of a line as STR, NUM or ID (words in keep stay), joined by spaces."""
    parts = F.regexp_extract_all(line, F.lit(r"""("[^"]*"|'[^']*'|[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_.]*|[^\sA-Za-z0-9_])"""), 1)

    def mask(x: Column) -> Column:
        kept = x.isin(*keep) if keep else F.lit(False)
        return F.when(kept, x).when(x.rlike(r"""^["']"""), "STR").when(x.rlike(r"^[0-9]"), "NUM").when(x.rlike(r"^[A-Za-z_]"), "ID").otherwise(x)

    return F.array_join(F.transform(parts, mask), " ")


def number_class(token: Column) -> Column:
    """INT_S for 0 to 10, INT_HEX for 0x..., INT_M for every other number."""
    return F.when(token.rlike("^0[xX][0-9a-fA-F_]+"), "INT_HEX").when(token.rlike(r"^(10|[0-9])$"), "INT_S").otherwise("INT_M")


def url_identity(url: Column) -> Column:
    """Host and path in lower case, without scheme, credentials, port, query, fragment, trailing slash and .git."""
    bare = F.regexp_replace(F.lower(F.btrim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"^[^/@]*@", "")
    bare = F.regexp_replace(bare, r"^([^/:]+):[0-9]+", "$1")
    return F.regexp_replace(F.regexp_replace(bare, r"/+$", ""), r"\.git$", "")


def storage_key(identity: Column) -> Column:
    """A readable slug of up to 48 characters and 24 digits of the identity's sha256."""
    slug = F.btrim(F.regexp_replace(identity, r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.substring(slug, 1, 48), F.lit("-"), F.substring(F.sha2(identity, 256), 1, 24))


#: Pieces of a page: whole elements that hold no prose, comments, tags, text, and a < that begins nothing.
PAGE_PIECE = r"(?is)(<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style|code\b[^>]*>.*?</code|pre\b[^>]*>.*?</pre)>|<!--.*?-->|<[^>]*>|[^<]+|<)"
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&hellip;": "…", "&amp;": "&"}


def visible_text(html: Column) -> Column:
    """The text of a page, white space folded: its pieces but tags, comments, scripts, styles and code, with a space for
    each piece left out, and the usual character references decoded."""
    pieces = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(PAGE_PIECE), 1)
    text = F.array_join(F.transform(pieces, lambda x: F.when(x.startswith("<") & (F.length(x) > 1), " ").otherwise(x)), "")
    for ref, char in REFERENCES.items():
        text = F.replace(text, F.lit(ref), F.lit(char))
    return fold_space(text)


def naming_style(text: Column) -> Column:
    """CamelCase or snake_case if its names are more than twice as many as the other's, else mixed: definitions by fn, void
    or int count for snake_case, capitalized words of four letters or more for CamelCase."""
    snake = F.regexp_count(text, F.lit(r"\b(?:fn|void|int)\s+[a-z][a-z0-9_]+\s*\("))
    camel = F.regexp_count(text, F.lit(r"\b[A-Z][A-Za-z0-9]{3,}\b"))
    return F.when(camel > 2 * snake, "CamelCase").when(snake > 2 * camel, "snake_case").otherwise("mixed")


def identifier_terms(text: Column) -> Column:
    """Distinct identifiers of a text in lower case, with _ at case changes, and their parts between underscores."""
    spaced = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"([a-z0-9])([A-Z])", "$1_$2"))
    names = F.regexp_extract_all(spaced, F.lit(r"([a-z][a-z0-9_]*)"), 1)
    return let(names, lambda n: F.array_union(n, F.filter(F.split(F.array_join(n, "_"), "_"), lambda x: x != "")))


def json_object(text: Column) -> Column:
    """A text as a variant if it is exactly one JSON object, else null.

    The parser stops after the first value, so the text is tried inside an array and inside an object too: what stands
    behind the first value breaks one of them.
    """
    inside = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"x":', "}"))]
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & inside[0] & inside[1], v)


def json_list(text: Column) -> Column:
    """The texts in a JSON list; an empty list for null, broken or other JSON."""
    v = F.try_parse_json(text)
    found = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.from_json(F.to_json(v), "array<string>"))
    return F.coalesce(found, F.array().cast("array<string>"))


def json_number(text: Column, path: str, default: float) -> Column:
    """The number at a path of a JSON text; default where there is none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), path, "double"), F.lit(default))
