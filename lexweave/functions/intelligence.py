"""Checks on model output held as JSON text, built on the variant functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.constants import CITATION_TYPES, DISPOSITIONS, REVIEW_THRESHOLD
from lexweave.functions.citations import has_citation
from lexweave.functions.text import let, strip

AUTHORITY_TYPE = (
    "struct<citation_string:string,case_name:string,citation_context:string,"
    "citation_type:string,paragraph_context:string>"
)
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_WHOLE = r"^[+-]?[0-9]+(?:\.0*)?\z"
# Words read as a boolean besides true and false themselves (fixed values)
_TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
_FALSE_WORDS = ("false", "f", "no", "n", "off", "0")
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[Tt _][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})?)?\z"


def parse_json(raw: Column) -> Column:
    """The text as one complete JSON value, else null.

    The parser stops after the first value, so the text is parsed once between
    brackets and once between braces: anything trailing breaks at least one.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    single = F.schema_of_variant(F.try_variant_get(listed, "$[0]", "variant")).isNotNull()
    second = F.schema_of_variant(F.try_variant_get(listed, "$[1]", "variant")).isNull()
    return F.when(single & second & boxed.isNotNull(), F.try_parse_json(raw))


def json_kind(value: Column) -> Column:
    """Kind of a JSON value by the name Python gives it."""
    return let(F.schema_of_variant(value), lambda kind: (
        F.when(kind.startswith("OBJECT"), "dict").when(kind.startswith("ARRAY"), "list")
        .when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int").when(kind == "VOID", "NoneType")
        .when(kind.isNotNull(), "float")
    ))


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _plain(item: Column, kind: str) -> Column:
    return F.try_variant_get(item, "$", kind)


def _text(item: Column, kind: Column) -> Column:
    return F.when(kind == "str", _plain(item, "string"))


def _number(item: Column, kind: Column) -> Column:
    """A number, a boolean, or text that spells a number."""
    spelled = strip(_plain(item, "string"))
    return (
        F.when(kind.isin("int", "float"), _plain(item, "double"))
        .when(kind == "bool", _plain(item, "boolean").cast("int").cast("double"))
        .when((kind == "str") & spelled.rlike(_NUMBER), spelled.try_cast("double"))
    )


def _whole(item: Column, kind: Column) -> Column:
    spelled = strip(_plain(item, "string"))
    real = _plain(item, "double")
    return (
        F.when(kind == "int", _plain(item, "bigint"))
        .when((kind == "float") & (real == F.floor(real)), real.try_cast("bigint"))
        .when(kind == "bool", _plain(item, "boolean").cast("bigint"))
        .when((kind == "str") & spelled.rlike(_WHOLE),
              F.regexp_extract(spelled, r"^([+-]?[0-9]+)", 1).try_cast("bigint"))
    )


def _flag(item: Column, kind: Column) -> Column:
    word = F.lower(_plain(item, "string"))
    real = _plain(item, "double")
    return (
        F.when(kind == "bool", _plain(item, "boolean"))
        .when(kind.isin("int", "float") & real.isin(0.0, 1.0), real == 1.0)
        .when((kind == "str") & word.isin(*_TRUE_WORDS), F.lit(True))
        .when((kind == "str") & word.isin(*_FALSE_WORDS), F.lit(False))
    )


def _moment_ok(item: Column, kind: Column) -> Column:
    spelled = _plain(item, "string")
    stamp = spelled.rlike(_STAMP) & F.regexp_replace(
        spelled, "[_t]", "T").try_cast("timestamp").isNotNull()
    return kind.isin("int", "float") | (
        (kind == "str") & F.coalesce(stamp | strip(spelled).rlike(_NUMBER), F.lit(False)))


# Declared fields: name, kind of check, required, permitted words (fixed values)
_METADATA_FIELDS = (
    ("extraction_model", "text", True, ()),
    ("extraction_timestamp", "moment", True, ()),
    ("raw_prompt_tokens", "count", True, ()),
    ("raw_completion_tokens", "count", True, ()),
)
_FIELDS = (
    ("holding", "text", True, ()),
    ("holding_confidence", "share", True, ()),
    ("legal_standard", "optional text", False, ()),
    ("disposition", "choice", True, DISPOSITIONS),
    ("disposition_confidence", "share", True, ()),
    ("key_authorities", "list", False, ()),
    ("dissent_present", "flag", False, ()),
    ("dissent_summary", "optional text", False, ()),
    ("concurrence_present", "flag", False, ()),
    ("concurrence_summary", "optional text", False, ()),
    ("legal_topics", "filled list", True, ()),
)
_AUTHORITY_FIELDS = (
    ("citation_string", "text", True, ()),
    ("case_name", "optional text", False, ()),
    ("citation_context", "text", True, ()),
    ("citation_type", "choice", True, CITATION_TYPES),
    ("paragraph_context", "text", True, ()),
)


def _checks(value: Column, fields) -> Column:
    """The declared fields of an object, each with its member and its rule, as an array."""
    return F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.lit(rule).alias("rule"), F.lit(needed).alias("needed"),
            F.array(*[F.lit(w) for w in words]).cast("array<string>").alias("words"),
            _member(value, name).alias("item"),
        ) for name, rule, needed, words in fields
    ])


def _problem(field: Column) -> Column:
    """What is wrong with one field, null when nothing is. One lambda serves all fields."""
    def by_kind(kind: Column) -> Column:
        item, rule = field.item, field.rule
        text, number, whole = _text(item, kind), _number(item, kind), _whole(item, kind)
        size = F.size(_plain(item, "array<variant>"))
        return (
            F.when(kind.isNull(), F.when(field.needed, "Field required"))
            .when(rule == "text", F.when(text.isNull(), "Input should be a valid string")
                  .when(F.length(text) == 0, "String should have at least 1 character"))
            .when(rule == "optional text",
                  F.when(~kind.isin("str", "NoneType"), "Input should be a valid string"))
            .when(rule == "choice", F.when(
                ~F.coalesce(F.array_contains(field.words, text), F.lit(False)),
                F.concat(F.lit("Input should be one of "), F.array_join(field.words, ", "))))
            .when(rule == "share", F.when(number.isNull(), "Input should be a valid number")
                  .when((number < 0) | F.isnan(number), "Input should be greater than or equal to 0")
                  .when(number > 1, "Input should be less than or equal to 1"))
            .when(rule == "count", F.when(whole.isNull(), "Input should be a valid integer")
                  .when(whole < 0, "Input should be greater than or equal to 0"))
            .when(rule == "flag",
                  F.when(_flag(item, kind).isNull(), "Input should be a valid boolean"))
            .when(rule == "moment",
                  F.when(~_moment_ok(item, kind), "Input should be a valid datetime"))
            .when(rule == "list", F.when(kind != "list", "Input should be a valid list"))
            .when(rule == "filled list", F.when(kind != "list", "Input should be a valid list")
                  .when(size == 0, "List should have at least 1 item"))
        )

    return let(json_kind(field.item), by_kind)


def _items(value: Column, name: str) -> Column:
    """Items of an array member, an empty array when it is none."""
    return let(_member(value, name), lambda m: F.coalesce(
        F.when(json_kind(m) == "list", _plain(m, "array<variant>")), F.array().cast("array<variant>")))


def _problems(checks: Column, prefix: Column) -> Column:
    said = F.transform(checks, lambda f: F.concat(prefix, f["name"], F.lit(": "), _problem(f)))
    return F.filter(said, lambda m: m.isNotNull())


def schema_issues(value: Column, metadata: bool = True) -> Column:
    """Messages for every field that breaks the declared shape; unknown fields pass."""
    def authority(item: Column, i: Column) -> Column:
        at = F.concat(F.lit("key_authorities."), i.cast("string"))
        return F.when(
            json_kind(item) != "dict", F.array(F.concat(at, F.lit(": Input should be an object")))
        ).otherwise(_problems(_checks(item, _AUTHORITY_FIELDS), F.concat(at, F.lit("."))))

    def topic(item: Column, i: Column) -> Column:
        return F.when(json_kind(item) != "str", F.concat(
            F.lit("legal_topics."), i.cast("string"), F.lit(": Input should be a valid string")))

    fields = _FIELDS + (_METADATA_FIELDS if metadata else ())
    topics = F.filter(F.transform(_items(value, "legal_topics"), topic), lambda m: m.isNotNull())
    return F.concat(
        _problems(_checks(value, fields), F.lit("")),
        F.flatten(F.transform(_items(value, "key_authorities"), authority)), topics)


def read_intelligence(value: Column) -> Column:
    """Typed record of a value that passed :func:`schema_issues`."""
    def words(item: Column, *names: str) -> list[Column]:
        return [F.try_variant_get(item, f"$.{n}", "string").alias(n) for n in names]

    def typed(name: str, read) -> Column:
        return let(_member(value, name), lambda m: read(m, json_kind(m)))

    def flag(name: str) -> Column:
        return F.coalesce(typed(name, _flag), F.lit(False)).alias(name)

    authorities = F.transform(_items(value, "key_authorities"), lambda a: F.struct(
        *words(a, *[name for name, *_ in _AUTHORITY_FIELDS])))
    return F.struct(
        *words(value, "holding"),
        typed("holding_confidence", _number).alias("holding_confidence"),
        *words(value, "legal_standard", "disposition"),
        typed("disposition_confidence", _number).alias("disposition_confidence"),
        authorities.alias("key_authorities"),
        flag("dissent_present"), *words(value, "dissent_summary"),
        flag("concurrence_present"), *words(value, "concurrence_summary"),
        F.transform(_items(value, "legal_topics"), lambda t: t.cast("string")).alias("legal_topics"),
    )


def rule_violations(intel: Column) -> Column:
    """Broken business rules of a typed record, as messages."""
    def share(name: str) -> Column:
        number = intel.getField(name)
        return F.when(~number.between(0.0, 1.0), F.concat(
            F.lit(f"{name} "), number.cast("string"), F.lit(" not in [0.0, 1.0]")))

    def authority(a: Column, i: Column) -> Column:
        at = F.concat(F.lit("key_authorities["), i.cast("string"), F.lit("]: "))
        return F.array(
            F.when(~a.citation_type.isin(*CITATION_TYPES), F.concat(
                at, F.lit("invalid citation_type '"), a.citation_type, F.lit("'"))),
            F.when(~has_citation(a.citation_string), F.concat(
                at, F.lit("citation_string '"), a.citation_string,
                F.lit("' does not match legal citation regex"))),
        )

    general = F.array(
        share("holding_confidence"),
        share("disposition_confidence"),
        F.when(~intel.disposition.isin(*DISPOSITIONS),
               F.concat(F.lit("Invalid disposition: "), intel.disposition)),
        F.when(F.size(intel.legal_topics) == 0, F.lit("legal_topics must contain at least one entry")),
    )
    every = F.concat(general, F.flatten(F.transform(intel.key_authorities, authority)))
    return F.filter(every, lambda m: m.isNotNull())


def review_status(confidence: Column, threshold: float = REVIEW_THRESHOLD) -> Column:
    return F.when(confidence < threshold, "needs_review").otherwise("completed")
