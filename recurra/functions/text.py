"""Text helpers: heads, record contents, messages, tokens, salvage."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Commit trailers that are usually not part of a message, and the patterns of the record formats.
TRAILERS = ("co-authored-by", "signed-off-by", "reviewed-by", "see-also")
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LOCATION_PATTERN = r"=> (.+?) ::"
TOKEN_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]"
PATH_ITEM_PATTERN = r'"path"\s*:\s*"([^"\n]+)"'
_WS = " \t\r\n"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS))


def first_line(text: Column, limit: int = 200) -> Column:
    """First non-empty line, trimmed, at most ``limit`` characters; empty if none."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, limit), F.lit(""))


def record_content(symptom: Column, path: Column, symbol: Column, reason: Column) -> Column:
    """``symptom => location :: reason`` with the path spaced out."""
    spaced = F.replace(F.replace(path, F.lit("/"), F.lit(" / ")), F.lit(".py"), F.lit(""))
    loc = F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(spaced, F.lit(" # "), symbol)).otherwise(spaced)
    return strip(F.concat(symptom, F.lit(" => "), loc, F.lit(" :: "), reason))


def location_in(content: Column) -> Column:
    """The location a content string names, NULL when it names none."""
    return F.when(F.regexp_like(content, F.lit(LOCATION_PATTERN)), strip(F.regexp_extract(content, LOCATION_PATTERN, 1)))


def clean_message(subject: Column, body: Column, trailers: tuple[str, ...] = TRAILERS) -> Column:
    """Subject without a trailing ``(#n)`` plus the body without trailer lines."""
    trailer = r"(?i)^(" + "|".join(trailers) + "):"
    kept = F.filter(F.transform(F.split(body, "\n"), lambda l: F.rtrim(l)), lambda l: ~F.regexp_like(strip(l), F.lit(trailer)))
    text = strip(F.array_join(kept, "\n"))
    head = strip(F.regexp_replace(subject, r"\s*\(#\d+\)\s*$", ""))
    return strip(F.concat(head, F.when(text != "", F.concat(F.lit("\n\n"), text)).otherwise(F.lit(""))))


def coerce_list(c: Column) -> Column:
    """NULL or '' -> []; a JSON array -> its items as strings; anything else -> [value]."""
    parsed = F.from_json(c, "array<string>")
    return (F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>"))
            .when(F.startswith(strip(c), F.lit("[")) & parsed.isNotNull(), parsed)
            .otherwise(F.array(c)))


def words(text: Column) -> Column:
    """Distinct words, separated by any Unicode white space."""
    return F.array_distinct(F.filter(F.split(text, SPACES), lambda w: w != ""))


def tokens(text: Column) -> Column:
    """Lower-cased identifiers, numbers and single symbols, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


def bigrams(toks: Column) -> Column:
    shifted = F.slice(toks, 2, F.size(toks))
    head = F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0)))
    return F.zip_with(head, shifted, lambda a, b: F.concat(a, F.lit(" "), b))


def salvaged_paths(response: Column) -> Column:
    """Completed ``path`` items of a broken response, in order."""
    return F.regexp_extract_all(response, F.lit(PATH_ITEM_PATTERN), F.lit(1))


FENCE_PATTERN = r"(?s)```(?:json)?\s*(.*?)```"
NAME_ITEM_PATTERN = r'"(?:path|qualname)"\s*:\s*"([^"\n]+)"'


def unfenced(response: Column) -> Column:
    """The body of the first fenced block, or the response itself."""
    return F.when(F.regexp_like(response, F.lit(FENCE_PATTERN)), F.regexp_extract(response, FENCE_PATTERN, 1)).otherwise(response)


def ranked_paths(response: Column) -> tuple[Column, Column]:
    """(salvaged, items joined by '|'): the parsed list, or what can be recovered in order.

    The list is ``files`` (items with a path) or ``functions`` (items with a path and a qualname, given as ``path::qualname``).
    A valid answer without either list goes to recovery like a broken one.
    """
    body = unfenced(response)
    parsed = F.from_json(body, "files array<struct<path:string>>, functions array<struct<path:string,qualname:string>>")
    files = parsed.getField("files").getField("path")
    functions = F.transform(parsed.getField("functions"), lambda f: F.concat_ws("::", f["path"], f["qualname"]))
    listed = F.when(F.try_parse_json(body).isNotNull(), F.coalesce(files, functions))
    # recovery of the function form: path and qualname alternate
    names = F.regexp_extract_all(body, F.lit(NAME_ITEM_PATTERN), F.lit(1))
    paired = F.transform(F.sequence(F.lit(0), F.floor(F.size(names) / 2) - 1), lambda i: F.concat_ws("::", F.get(names, (2 * i).cast("int")), F.get(names, (2 * i + 1).cast("int"))))
    recovered = F.when(F.contains(body, F.lit('"qualname"')) & (F.size(names) > 1), paired).otherwise(salvaged_paths(body))
    return listed.isNull().alias("salvaged"), F.array_join(F.coalesce(listed, recovered), "|").alias("paths")
