r"""Fill-in-middle transformation by delimiters that are written into the text.

One character serves as delimiter and one as escape. The text's own ones are escaped, so no delimiter is
left; ``regexp_replace`` puts one behind each unit; their number is the number of units; and ``substring_index`` then
takes the units up to a rank, or from one on. What it took loses the delimiters and the escapes. Only built-in
functions are used, nothing is shuffled, and a row needs nothing but itself.

Defined results: a null text is the empty one; an empty text, and one that contains a marker, is ``plain``; a null id
is hashed as the empty text, and rows that share an id are cut by the same numbers; a text of any length is cut whole;
repeated rows give repeated rows; extra columns, whatever their names, are ignored; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units, as patterns over escaped text: an escape and what follows it are one character of the text.
CODE_POINT = r"(?s)\x02.|."
#: Words with the white space behind them; white space at the start is a unit of its own.
WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Form:
    """How texts are cut and put together; rates are in percent."""

    unit: str = CODE_POINT
    fim_rate: int = 90
    spm_rate: int = 20
    seed: str = "1"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


_DELIMITER, _ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """``text`` without the delimiter, and with the escape only before an ``e`` (itself) or a ``d`` (the delimiter)."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_DELIMITER), F.lit(_ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    bare = F.replace(part, F.lit(_DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "d"), F.lit(_DELIMITER)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def marked(text: Column, unit: str) -> Column:
    """``text`` escaped, with a delimiter behind each unit."""
    return F.regexp_replace(escaped(text), F.lit(unit), F.lit("$0" + _DELIMITER))


def count_units(m: Column) -> Column:
    return (F.length(m) - F.length(F.replace(m, F.lit(_DELIMITER), F.lit("")))).cast("long")


def first_units(m: Column, k: Column) -> Column:
    """The first ``k`` units of a marked text, still marked between them."""
    return F.call_function("substring_index", m, F.lit(_DELIMITER), k.cast("int"))


def last_units(m: Column, k: Column) -> Column:
    """The last ``k`` units. A marked text ends with a delimiter, a part of it taken from the front doesn't."""
    return F.call_function("substring_index", m, F.lit(_DELIMITER), -k.cast("int"))


def numbers(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned numbers of 32 bits from the id: the first groups of its SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, text, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain), output.

    A text's own units end the prefix after the smaller of two numbers, and the middle after the larger.
    """
    h = numbers(F.col("doc_id"), form.seed)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = own.withColumn("m", marked(F.col("text"), form.unit)).withColumn("n", count_units(F.col("m")))
    has_marker = F.contains("text", F.lit(form.prefix)) | F.contains("text", F.lit(form.suffix)) | F.contains("text", F.lit(form.middle))
    plain = (F.col("text") == "") | has_marker | (h[2] % 100 >= form.fim_rate)
    cut = cut.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < form.spm_rate, "spm").otherwise("psm"))
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    cut = cut.withColumns({"a": F.least(one, two), "b": F.greatest(one, two)})
    some = F.col("form") != "plain"
    parts = {
        "prefix": first_units(F.col("m"), F.col("a")),
        "middle": last_units(first_units(F.col("m"), F.col("b")), F.col("b") - F.col("a")),
        "suffix": last_units(F.col("m"), F.col("n") - F.col("b") + 1),
    }
    out = cut.withColumns({k: F.when(some, unescaped(v)) for k, v in parts.items()})
    psm = F.concat(F.lit(form.prefix), "prefix", F.lit(form.suffix), "suffix", F.lit(form.middle), "middle")
    spm = F.concat(F.lit(form.suffix), "suffix", F.lit(form.prefix), "prefix", F.lit(form.middle), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return out.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, kind: Column, form: Form = Form()) -> Column:
    """The text that ``output`` was made of. No part contains a marker, nor can a marker begin within a part and end
    in the next marker, so each one's first place is its own."""
    cut = lambda c, by, k: F.call_function("substring_index", c, F.lit(by), F.lit(k))

    def whole(first: str, second: str, prefix_first: bool) -> Column:
        body = F.substr(output, F.lit(len(first) + 1))
        one, rest = cut(body, second, 1), cut(body, second, -1)
        two, middle = cut(rest, form.middle, 1), cut(rest, form.middle, -1)
        return F.concat(one, middle, two) if prefix_first else F.concat(two, middle, one)

    return F.when(kind == "psm", whole(form.prefix, form.suffix, True)).when(kind == "spm", whole(form.suffix, form.prefix, False)).otherwise(output)


def digests(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    made = transform(docs, form)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"), form)).alias("restored_sha256"),
    )
