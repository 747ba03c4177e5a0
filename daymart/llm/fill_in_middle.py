"""Fill-in-middle: a text cut into prefix, middle and suffix at line borders, and put back together.

``regexp_count`` gives a text's lines; a hash of the id picks two of their borders. One pattern a row then
counts that many lines off with possessive quantifiers, ``((?:line){a}+)((?:line){b}+)(rest)``, so the three
parts are captured in one match that neither backtracks nor recurses, however long the text; its replacement
writes them in the order of the form. All of it is built-in expressions of one projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINE = r"[^\n]*+\n|[^\n]++"
#: What the replacement writes for each form, and what takes each apart again.
WRITTEN = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
APART = {"psm": f"{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)", "spm": f"{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)"}
TOGETHER = {"psm": "$1$3$2", "spm": "$2$3$1"}


def _by_form(form: Column, plain: Column, make) -> Column:
    return F.when(form == "psm", make("psm")).when(form == "spm", make("spm")).otherwise(plain)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", percent: int = 100, percent_spm: int = 50
) -> DataFrame:
    """``id_col, n long, form string, prefix_chars long, middle_chars long, output string`` for each row.

    ``n`` counts the lines, a last one without line feed included. Of the hash of ``seed:id`` four numbers
    are taken: two choose the borders, one whether a text is transformed at all (``percent`` of the ids),
    one between ``spm`` and ``psm``. A text that is null (taken as empty), empty or already holds one of
    the three marks stays as it is: form ``plain``, null lengths. Lengths are code points. A null id
    counts as the empty string; repeated rows come out alike; other columns of any name are ignored;
    an empty table gives an empty one.
    """
    number = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    held = F.greatest(*[F.instr("text", mark) for mark in (PREFIX, SUFFIX, MIDDLE)]) > 0
    plain = (F.col("text") == "") | held | (number[2] % 100 >= percent)
    cuts = [number[i] % (F.col("n") + 1) for i in (0, 1)]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        F.regexp_count("text", F.lit(LINE)).cast("long").alias("n"),
        F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), "UTF-8"), 256).alias("digest"),
    )
    rows = rows.select(
        "id",
        "text",
        "n",
        F.when(plain, "plain").when(number[3] % 100 < percent_spm, "spm").otherwise("psm").alias("form"),
        F.least(*cuts).alias("first"),
        F.abs(cuts[0] - cuts[1]).alias("second"),
    )
    counted = F.format_string(rf"(?s)\A((?:{LINE}){{%d}}+)((?:{LINE}){{%d}}+)(.*)\z", "first", "second")
    rows = rows.withColumn("pattern", counted)
    output = _by_form(F.col("form"), F.col("text"), lambda form: F.regexp_replace("text", F.col("pattern"), F.lit(WRITTEN[form])))
    rows = rows.select("id", "n", "form", output.alias("output"))
    # Marks cannot overlap and the text holds none, so the first of each kind in the output is the one written.
    at = {mark: F.instr("output", mark) for mark in (PREFIX, SUFFIX, MIDDLE)}
    prefix = _by_form(F.col("form"), F.lit(None), lambda form: at[SUFFIX if form == "psm" else MIDDLE] - at[PREFIX] - len(PREFIX))
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at[MIDDLE] - len(MIDDLE) + 1)
    return rows.select(
        F.col("id").alias(id_col),
        "n",
        "form",
        prefix.cast("long").alias("prefix_chars"),
        middle.cast("long").alias("middle_chars"),
        "output",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a known form was made of; null where either is null."""
    return F.when(form.isNotNull(), _by_form(form, output, lambda f: F.regexp_replace(output, rf"(?s)\A{APART[f]}\z", TOGETHER[f])))
