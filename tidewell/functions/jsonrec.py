"""Records out of JSON bodies, on VARIANT.

Types come from the VARIANT of an element, texts of numbers from its JSON text, because VARIANT
normalises ``8080.0`` to ``8080`` and a port of that form must be rejected. Objects with repeated keys are not valid
VARIANTs and yield nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.entry import parse_entries
from tidewell.functions.gate import clean_credential, credentials_ok, port_number
from tidewell.functions.hosts import with_host
from tidewell.functions.scheme import SCHEMES, canon, ordered
from tidewell.functions.text import WS, after_last, bind, count_of

# The keys that are looked up, in this order.
ENVELOPE_KEYS = ["proxies", "data", "result", "results", "list", "items", "nodes", "output"]
HOST_KEYS = ["ip", "host", "proxy", "addr", "address", "server", "ip_address"]
USER_KEYS = ["username", "user", "login", "proxy_username"]
PASS_KEYS = ["password", "pass", "pwd", "proxy_password"]
SCHEME_LIST_KEYS = ["protocols", "schemes"]
SCHEME_KEYS = ["protocol", "type", "scheme"]

STRINGS = "array<string>"


def parse_strict(text: Column) -> Column:
    """One whole JSON value as VARIANT. ``try_parse_json`` alone would accept text after the first value."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.size(F.try_variant_get(boxed, "$", "array<variant>")) == 1, F.try_variant_get(boxed, "$[0]", "variant"))


def variant_string(v: Column, path: str) -> Column:
    """A string value at a path; NULL for other types (numbers do not become text)."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def first_string(v: Column, keys: list[str]) -> Column:
    """The first of the keys whose value is a string."""
    return F.coalesce(*[variant_string(v, f"$.{k}") for k in keys])


def unsigned(v: Column, key: str) -> Column:
    """A non-negative integer at a key; numeric strings and fractions are none."""
    at = F.try_variant_get(v, f"$.{key}", "variant")
    n = F.try_variant_get(v, f"$.{key}", "bigint")
    return F.when((F.schema_of_variant(at) == "BIGINT") & (n >= 0), n)


def unwrap(df: DataFrame, body: str, out: str = "elements") -> DataFrame:
    """Adds the JSON texts of a body's records: the array itself, the first envelope array, the first array of
    objects in key order, nothing for an envelope key without an array, or the object as such."""
    d = bind(df, _v=parse_strict(F.col(body)))
    is_array = F.try_variant_get("_v", "$", "array<variant>").isNotNull()
    fields = F.try_variant_get("_v", "$", "map<string,variant>")
    d = bind(d, _is_array=is_array, _fields=fields)
    chosen = [F.when(F.try_variant_get("_v", f"$.{k}", "array<variant>").isNotNull(), F.lit(k)) for k in ENVELOPE_KEYS]
    listed = F.filter(F.array_sort(F.map_keys("_fields")), lambda k: F.startswith(F.schema_of_variant(F.try_variant_get(F.element_at("_fields", k), "$[0]", "variant")), F.lit("OBJECT")))
    enveloped = F.exists(F.array(*map(F.lit, ENVELOPE_KEYS)), lambda k: F.array_contains(F.map_keys("_fields"), k))
    d = bind(d, _key=F.coalesce(*chosen, F.get(listed, F.lit(0))))
    raw = F.from_json(F.col(body), "map<string,string>")
    own = F.from_json(F.element_at(raw, F.col("_key")), STRINGS)
    elements = (
        F.when(F.col("_is_array"), F.from_json(F.col(body), STRINGS))
        .when(F.col("_key").isNotNull(), own)
        .when(F.col("_fields").isNotNull() & ~enveloped, F.array(F.col(body)))
    )
    # the element's type decides between a record and an entry string
    types = F.when(F.col("_is_array"), F.try_variant_get("_v", "$", "array<variant>")).when(F.col("_key").isNotNull(), F.try_variant_get(F.element_at("_fields", F.col("_key")), "$", "array<variant>"))
    text = F.transform(types, lambda x: F.schema_of_variant(x) == "STRING")
    empty = F.array().cast("array<struct<text:string,is_text:boolean>>")
    paired = F.transform(F.arrays_zip(elements.alias("e"), F.coalesce(text, F.array(F.lit(False))).alias("t")), lambda z: F.struct(z["e"].alias("text"), z["t"].alias("is_text")))
    return bind(d, **{out: F.coalesce(paired, empty)}).drop("_v", "_is_array", "_fields", "_key")


def declared_schemes(v: Column) -> Column:
    """Recognised schemes of a record, in scheme order; an empty array if it declares none."""
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in SCHEME_LIST_KEYS]
    strings = F.transform(F.coalesce(*lists), lambda x: canon(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
    single = F.coalesce(*[canon(variant_string(v, f"$.{k}")) for k in SCHEME_KEYS])
    many = ordered(F.coalesce(strings, F.array().cast(STRINGS)))
    return F.when(F.size(many) > 0, many).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast(STRINGS))


def without_userinfo(endpoint: Column) -> Column:
    """An endpoint without embedded credentials, its scheme kept."""
    head = F.when(F.contains(endpoint, F.lit("://")), F.concat(F.substring_index(endpoint, "://", 1), F.lit("://"))).otherwise(F.lit(""))
    rest = F.when(F.contains(endpoint, F.lit("://")), F.substring(endpoint, F.instr(endpoint, "://") + 3, F.length(endpoint))).otherwise(endpoint)
    plain = F.when(F.contains(rest, F.lit("@")), after_last(rest, "@")).when(~F.contains(rest, F.lit("]")) & (count_of(rest, ":") == 3), F.substring_index(rest, ":", 2)).otherwise(rest)
    return F.concat(head, plain)


def record_endpoints(df: DataFrame, element: str = "element", is_text: str = "is_text", default: str = "default_scheme") -> DataFrame:
    """Raw endpoint fields (scheme, host, port, user, pass), one row for each scheme of a record.

    Rows still have to pass the gate. All in one narrow stage: staged projections and one explode.
    """
    blank = rf"(?s)^{WS}.*|.*{WS}\z"
    d = bind(df, _jv=F.when(~F.col(is_text), F.try_parse_json(F.col(element))))
    d = bind(
        d,
        _jhost=F.when(F.col(is_text), F.col(element)).otherwise(first_string(F.col("_jv"), HOST_KEYS)),
        _juser=first_string(F.col("_jv"), USER_KEYS),
        _jpass=first_string(F.col("_jv"), PASS_KEYS),
        _jown=F.coalesce(declared_schemes(F.col("_jv")), F.array().cast(STRINGS)),
    )
    d = d.filter(F.col("_jhost").isNotNull() & ~F.col("_jhost").rlike(blank))
    dedicated = F.col("_juser").isNotNull() | F.col("_jpass").isNotNull()
    port_at = F.try_variant_get("_jv", "$.port", "variant")
    number = "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|STRING)"
    d = bind(
        d,
        _dedicated=dedicated,
        _end=F.when(dedicated, without_userinfo(F.col("_jhost"))).otherwise(F.col("_jhost")),
        _jdeclared=F.size("_jown") > 0,
        _schemes=F.when(F.size("_jown") > 0, F.col("_jown")).when(F.col(default).isNotNull(), F.array(F.col(default))).otherwise(F.array().cast(STRINGS)),
        _jport=F.when(F.schema_of_variant(port_at).rlike(number), F.get_json_object(F.col(element), "$.port")),
    )
    own_scheme = F.contains("_end", F.lit("://"))
    d = bind(d, _self=own_scheme, _desc=own_scheme | F.contains("_end", F.lit("]")), _default=F.when(~own_scheme, F.get("_schemes", F.lit(0))))
    d = parse_entries(d, "_end", "_default", "_e_")
    d = with_host(d, "_e_host", "_e_ok")
    d = with_host(d, "_end", "_end_ok")
    parsed = F.col("_e_ok").isNotNull() & port_number(F.col("_e_port")).isNotNull() & F.col("_e_scheme").isNotNull() & credentials_ok(F.col("_e_user"), F.col("_e_pass"))
    tail_is_port = F.col("_jport").isNotNull() & ~F.col("_desc") & F.col("_end_ok").isNotNull()
    d = bind(d, _hit=F.coalesce(parsed, F.lit(False)) & ~(F.coalesce(tail_is_port, F.lit(False)) & ~F.col(is_text)))
    fan = F.when(F.col("_hit") & (F.col("_self") | (F.size("_schemes") == 0) | ~(F.col("_jdeclared") & ~F.col("_desc"))), F.when(F.col("_self") | (F.size("_schemes") <= 1), F.array("_e_scheme")).otherwise(F.col("_schemes"))).when(F.col("_hit"), F.col("_schemes")).when(~F.col(is_text), F.col("_schemes"))
    d = d.withColumn("scheme", F.explode(fan))
    own_user = F.when(F.col("_dedicated"), F.col("_juser")).otherwise(F.when(F.col("_hit"), F.col("_e_user")))
    own_pass = F.when(F.col("_dedicated"), F.col("_jpass")).otherwise(F.when(F.col("_hit"), F.col("_e_pass")))
    d = d.withColumns(
        {
            "host": F.when(F.col("_hit"), F.col("_e_host")).when(F.col("_end_ok").isNotNull(), F.col("_end")),
            "port": F.when(F.col("_hit"), F.col("_e_port")).otherwise(F.col("_jport")),
            "user": own_user,
            "pass": own_pass,
        }
    )
    return d.drop(*[c for c in d.columns if c.startswith("_")])


__all__ = ["SCHEMES", "clean_credential", "declared_schemes", "first_string", "record_endpoints", "unsigned", "unwrap", "variant_string", "without_userinfo"]
