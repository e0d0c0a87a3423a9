"""Header and request JSON as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import count_char

_MAP = "map<string,variant>"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def one_value(text: Column, quotes: str = "false") -> Column:
    """Whether a text is a single JSON value. Spark's reader stops after the first value, so the
    text is read in brackets and as a member: no tail fits into both."""
    options = {"allowSingleQuotes": quotes}
    item = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", options)
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", options)
    return F.coalesce((F.size(item) == 1) & (F.size(member) == 1), F.lit(False))


def entries(text) -> Column:
    """Entries of a JSON object as array<struct<key, value variant, raw string>> in text
    order, the last of equal keys kept; null if the text is no JSON object. `raw` is the
    text of a nested value with its keys as they stand."""
    options = {"allowSingleQuotes": "false"}
    values = F.map_entries(F.from_json(_col(text), _MAP, options))
    texts = F.map_entries(F.from_json(_col(text), "map<string,string>", options))
    raw = F.zip_with(values, texts, lambda v, t: F.struct(v["key"].alias("key"), v["value"].alias("value"), t["value"].alias("raw")))
    return last_of_equal_keys(F.when(one_value(_col(text)), raw))


def value_text(entry: Column) -> Column:
    """The value of one of `entries` as compact JSON; nested keys stay in order."""
    plain = F.to_json(entry["value"])
    return F.when(F.left(plain, F.lit(1)).isin("{", "["), entry["raw"]).otherwise(plain)


def last_of_equal_keys(pairs: Column) -> Column:
    """Like a Python dict: a key keeps its first place and its last value."""
    def body(pairs):
        keys = F.transform(pairs, lambda e: e["key"])
        first = F.filter(pairs, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
        deduped = F.transform(first, lambda e: F.element_at(
            F.filter(pairs, lambda o: o["key"] == e["key"]), -1))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(deduped)
    return bind(pairs, body)


def quoted(text: Column) -> Column:
    """A string as a JSON string literal."""
    return F.to_json(text.cast("variant"))


def canonical(text) -> Column:
    """Compact JSON with sorted keys, of equal keys the last; text that is no JSON is left alone."""
    # a variant cannot hold equal keys: such an object is put together from its entries
    members = F.transform(F.array_sort(F.transform(entries(text), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("json")))),
                          lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["json"]))
    again = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    return F.coalesce(F.when(one_value(_col(text)), F.coalesce(F.to_json(F.try_parse_json(_col(text))), again)), _col(text))


def parse_object(text) -> Column:
    """Tolerant form: JSON object, single-quoted object, else an empty map."""
    parsed = F.from_json(_col(text), "map<string,string>", {"allowSingleQuotes": "true"})
    return F.coalesce(F.when(one_value(_col(text), "true"), parsed), F.create_map().cast("map<string,string>"))


# Spellings tried before any other case.
UA_KEYS = ("User-Agent", "user-agent", "USER-AGENT")


def user_agent(text) -> Column:
    """User-Agent of a headers text, '' if there is none, 'None' if it is a JSON null."""
    def spelled(pairs, key):
        return F.try_element_at(F.filter(pairs, lambda e: e["key"] == key), F.lit(-1))

    def body(pairs):
        loose = F.filter(pairs, lambda e: F.lower(e["key"]) == "user-agent")
        found = F.coalesce(*[spelled(pairs, key) for key in UA_KEYS], F.try_element_at(loose, F.lit(1)))
        return bind(found, lambda e: F.when(e.isNull(), "").otherwise(F.coalesce(e["value"], F.lit("None"))))
    return bind(F.map_entries(parse_object(text)), body)


def map_text(m, spaced: bool = True) -> Column:
    """A map<string,string> as JSON text; a null map is '{}'."""
    colon, comma = (": ", ", ") if spaced else (":", ",")
    pairs = F.transform(F.map_entries(_col(m)),
                        lambda e: F.concat(quoted(e["key"]), F.lit(colon), quoted(e["value"])))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(pairs, comma), F.lit("}")), F.lit("{}"))


def with_user_agent(headers: Column, agent: Column) -> Column:
    """Put the User-Agent column back into the header map unless a spelling of
    it is there already."""
    base = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    present = F.map_contains_key(base, "User-Agent") | F.map_contains_key(base, "user-agent")
    add = (F.coalesce(agent, F.lit("")) != "") & ~present
    return F.when(add, F.map_concat(base, F.create_map(F.lit("User-Agent"), agent))).otherwise(base)


def manual_counts(headers, request) -> list[Column]:
    """Lengths and colon counts of both texts."""
    h, r = _col(headers), _col(request)
    return [F.length(h).cast("double"), F.length(r).cast("double"),
            count_char(h, ":").cast("double"), count_char(r, ":").cast("double")]


def vary_case(key: Column, pick: Column) -> Column:
    """lower / UPPER / Dash-Title, a third of [0, 1) each."""
    title = F.array_join(F.transform(
        F.split(key, "-"),
        lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "-")
    return (F.when(pick < 1 / 3, F.lower(key))
            .when(pick < 2 / 3, F.upper(key)).otherwise(title))


# Fixed value: a dotted version number.
VERSION = r"\d+(?:\.\d+)+"


def mask_versions(text: Column) -> Column:
    """Digits of dotted version numbers become X; lone numbers stay."""
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s){VERSION}|."), F.lit(0))
    masked = F.transform(tokens, lambda t: F.when(
        F.length(t) > 1, F.regexp_replace(t, "[0-9]", "X")).otherwise(t))
    return F.array_join(masked, "")
