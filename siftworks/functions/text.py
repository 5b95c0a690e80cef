"""Column functions over paths, names, source text, identifiers and scores. All stay in the JVM unless they say so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of the languages that are measured.
LANGUAGES = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "java": "java", "py": "python"}
# Fixed values of the evidence contract.
#: Declaration kinds and their kinds in the graph.
GRAPH_KINDS = {
    "module": "module", "namespace": "module", "type": "class", "implementation": "class", "method": "method", "constructor": "method", "function": "function", "anonymousFunction": "function",
    "field": "field", "variable": "variable", "parameter": "parameter", "typeParameter": "typeParameter", "alias": "alias",
}
#: Grammar nodes that declare something, by language. Rust functions in an implementation or trait are methods, Java
#: variable declarators in a field declaration fields, and Python assignments count only to a plain identifier.
NODE_KINDS = {
    "java": {
        "class_declaration": "type", "interface_declaration": "type", "enum_declaration": "type", "record_declaration": "type", "annotation_type_declaration": "type", "method_declaration": "method",
        "annotation_type_element_declaration": "method", "constructor_declaration": "constructor", "compact_constructor_declaration": "constructor", "lambda_expression": "anonymousFunction",
        "variable_declarator": "variable", "formal_parameter": "parameter", "spread_parameter": "parameter",
    },
    "python": {"class_definition": "type", "function_definition": "function", "lambda": "anonymousFunction", "assignment": "variable", "typed_parameter": "parameter", "default_parameter": "parameter"},
    "rust": {
        "struct_item": "type", "enum_item": "type", "trait_item": "type", "union_item": "type", "impl_item": "implementation", "mod_item": "namespace", "function_item": "function", "function_signature_item": "function",
        "closure_expression": "anonymousFunction", "field_declaration": "field", "type_item": "alias", "const_item": "variable", "static_item": "variable", "parameter": "parameter",
    },
    "javascript": {
        "class_declaration": "type", "class": "type", "method_definition": "method", "function_declaration": "function", "function_expression": "function", "generator_function_declaration": "function",
        "generator_function": "function", "arrow_function": "anonymousFunction", "variable_declarator": "variable", "field_definition": "field", "formal_parameter": "parameter",
    },
}
#: Grammar nodes that call something, by language.
CALL_NODES = {
    "java": ("method_invocation", "object_creation_expression", "explicit_constructor_invocation"), "rust": ("call_expression", "method_call_expression"),
    "python": ("call",), "javascript": ("call_expression", "new_expression"),
}
#: Roles of references in order; Java has no alias.
ROLES = ("definition", "read", "write", "call", "type", "import", "alias")
#: Words that carry no focus in a question.
STOP_WORDS = ("the", "and", "are", "does", "how", "what", "where", "when", "which", "why", "this", "that", "with", "from", "for", "into", "calls", "call", "function")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language(path: Column) -> Column:
    """Language by the path's extension; null for all others."""
    return _lookup(LANGUAGES, F.nullif(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1), F.lit("")))


def graph_kind(kind: Column) -> Column:
    """Graph kind of a declaration kind; null for an unknown one, which graph_kind_violations() reports."""
    return _lookup(GRAPH_KINDS, kind)


def node_kind(lang: Column, node: Column, in_container: Column) -> Column:
    """Declaration kind of a grammar node; null for nodes that declare nothing. in_container: whether it stands in a
    Rust implementation or trait, or in a Java field declaration."""
    table = F.create_map(*[F.lit(x) for lg, kinds in NODE_KINDS.items() for n, k in kinds.items() for x in (f"{lg}/{n}", k)])
    kind = F.element_at(table, F.concat_ws("/", lang, node))
    return F.when(in_container & (lang == "rust") & (kind == "function"), "method").when(in_container & (lang == "java") & (node == "variable_declarator"), "field").otherwise(kind)


def is_call_node(lang: Column, node: Column) -> Column:
    return F.coalesce(F.array_contains(F.element_at(F.create_map(*[x for lg, ns in CALL_NODES.items() for x in (F.lit(lg), F.array(*[F.lit(n) for n in ns]))]), lang), node), F.lit(False))


def applicable_roles(lang: Column) -> Column:
    every = [F.lit(r) for r in ROLES]
    return F.when(lang == "java", F.array(*every[:-1])).when(lang.isin("rust", "python", "javascript"), F.array(*every))


def valid_path(path: Column) -> Column:
    """Relative POSIX path: no backslash, colon or NUL, and no empty, . or .. segment."""
    clean = ~path.rlike(r"[\\:\x00]")
    return F.coalesce((F.length(path) > 0) & clean & F.forall(F.split(path, "/"), lambda s: ~s.isin("", ".", "..")), F.lit(False))


def line_count(text: Column) -> Column:
    """One more than the line feeds."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("long")


def display_key(path: Column, names: Column, kind: Column, ordinal: Column, start: Column) -> Column:
    """path#Outer.own; an unnamed part shows as kind@ordinal, or kind@start without an ordinal."""
    shown = F.array_join(names, ".", "")
    fallback = F.concat_ws("@", kind, F.coalesce(ordinal, start).cast("string"))
    return F.concat(path, F.lit("#"), F.when(F.size(names) > 0, F.when(F.element_at(names, -1).isNotNull(), shown).otherwise(F.concat_ws(".", shown, fallback))).otherwise(fallback))


def node_name(kind: Column, name: Column, path: Column, start: Column) -> Column:
    """A declaration without a name is named by its path if it is a module, else by <kind@start>."""
    return F.coalesce(name, F.when(kind == "module", path).otherwise(F.concat(F.lit("<"), kind, F.lit("@"), start.cast("string"), F.lit(">"))))


def region_label(text: Column, n: int = 140) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)


def is_accessor(modifiers: Column) -> Column:
    return F.arrays_overlap(modifiers, F.array(F.lit("get"), F.lit("set")))


def clip_bytes(text: Column, n: int) -> Column:
    """struct(text, clipped): at most n bytes of UTF-8, never part of a character."""
    raw = F.encode(text, "UTF-8")
    # back from n to the start of the character that byte n + 1 belongs to; a character has at most four bytes
    at = F.expr("0")
    for back in (3, 2, 1, 0):
        inside = F.hex(F.substring(raw, n + 1 - back, 1)).rlike("^[89AB]")
        at = F.when(~inside, F.lit(n - back)).otherwise(at) if back < 3 else F.lit(n - 3)
    cut = F.decode(F.substring(raw, F.lit(1), at), "UTF-8")
    over = F.octet_length(raw) > n
    return F.struct(F.when(over, cut).otherwise(text).alias("text"), over.alias("clipped"))


def byte_slice(data: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of binary data."""
    return F.substring(data, (start + 1).cast("int"), (end - start).cast("int"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def literal_contains(text: Column, query: Column) -> Column:
    """Literal search that knows ASCII case alone, without wildcards or patterns."""
    return F.instr(ascii_lower(text), ascii_lower(query)) > 0


def symbol_contains(name: Column, qualified: Column, query: Column) -> Column:
    q = F.lower(query)
    return F.coalesce(F.contains(F.lower(name), q), F.lit(False)) | F.coalesce(F.contains(F.lower(qualified), q), F.lit(False))


def focus_terms(question: Column, given: Column) -> Column:
    """Given terms, trimmed and lower-cased; without any, the question's distinct words, sorted: letters, digits and _,
    more than two bytes, without stop words."""
    words = F.filter(F.split(F.lower(question), r"[^\p{IsAlphabetic}\p{N}_]+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.when(F.size(given) > 0, F.transform(given, lambda t: F.lower(F.trim(t)))).otherwise(F.array_sort(F.array_distinct(words)))


def literal_match(text: Column, terms: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(terms, lambda t: F.contains(low, t))


def identifier_words(name: Column) -> Column:
    """Words of camelCase, snake_case and ACRONYMName, lower-cased."""
    cut = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_remove(F.split(F.lower(cut), r"[^a-z0-9]+"), "")


def is_dotted(name: Column) -> Column:
    return name.rlike(r"^[\p{IsAlphabetic}_$][\p{IsAlphabetic}\p{N}_$]*(\.[\p{IsAlphabetic}_$][\p{IsAlphabetic}\p{N}_$]*)*\z")


def module_name(path: Column) -> Column:
    """Dotted module of a Python path."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")


def valid_record_id(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]{1,128}$")


def probability_status(p: Column) -> Column:
    """exact, rounded or invalid, of a map of label probabilities: each in 0..1, and the sum within 0.002 of one, or
    within 0.01 if all have two decimals."""
    values = F.map_values(p)
    finite = F.forall(values, lambda v: v.isNotNull() & (v >= 0) & (v <= 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    rounded = F.forall(values, lambda v: F.abs(v * 100 - F.round(v * 100)) < 1e-9)
    off = F.abs(total - 1)
    return F.when(finite & (off <= 0.002 + 1e-12), "exact").when(finite & rounded & (off <= 0.01 + 1e-12), "rounded").otherwise("invalid")


def excerpt(text: Column, n: int, mark: str = "\n…\n") -> Column:
    """65 % from the head and 35 % from the tail of a text of more than n characters."""
    head = n * 65 // 100
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(n - head)))).otherwise(text)


def crate_alias(name: Column) -> Column:
    return F.translate(name, "-", "_")


def age_seconds(now: Column, then: Column) -> Column:
    return F.timestamp_diff("SECOND", then, now)


def wilson_lower(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Lower end of the 95 % two-sided Wilson interval; null without trials."""
    p, zz = k / n, z * z
    low = (p + zz / (2 * n) - z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0)))


# --- canonical text and digests --------------------------------------------------------------------------------------


def json_string(text: Column) -> Column:
    """Canonical JSON string: quote and backslash escaped by a backslash, every control character as \\u00xx."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u00{code:02x}"))
    escaped = F.when(text.rlike(r"[\x00-\x1f]"), out).otherwise(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("long").cast("string"), F.lit("null"))


def json_bool(value: Column) -> Column:
    return F.coalesce(value.cast("boolean").cast("string"), F.lit("null"))


def json_array(items: Column, one) -> Column:
    """Canonical JSON of an array; one gives that of an item."""
    return F.when(items.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(items, one), ","), F.lit("]")))


def json_object(**fields: Column) -> Column:
    """Canonical JSON of an object of canonical values: keys in byte order, nulls kept, no white space."""
    parts = []
    for k in sorted(fields):
        parts += [F.lit(("," if parts else "") + f'"{k}":'), fields[k]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def domain_digest(domain: str, canonical: Column) -> Column:
    """SHA-256 of the domain, a NUL and the canonical bytes."""
    return F.sha2(F.concat(F.lit(domain.encode() + b"\x00"), F.encode(canonical, "UTF-8")), 256)
