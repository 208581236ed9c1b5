"""Multiple-choice items from raw records: each builder gives id, context, choices, gold for ``scoring.items``."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions.text import clean_markers, nfc

#: Prompt marks, verbalizers, fields and answers of the sets.
QUESTION, ANSWER, TAG = "Câu hỏi", "Trả lời", "đúng không?"
VERBALIZERS = ("Đúng", "Ngoài ra", "Không")
READING_FIELDS = ("flores_passage", "question", "mc_answer1", "mc_answer2", "mc_answer3", "mc_answer4", "correct_answer_num")
LETTERS = "ABCD"


def refuse(condition: Column, message: str, value: Column, kind: str) -> Column:
    """The value where the condition holds; the query fails where it does not."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def item(key: Column, context: Column, choices: Column, gold: Column) -> list[Column]:
    """One item: NFC, each choice with one leading blank; fewer than two choices, a blank one or a gold out of range fail."""
    good = (F.size(choices) >= 2) & gold.between(0, F.size(choices) - 1) & F.forall(choices, lambda c: F.trim(c) != "")
    spaced = F.transform(choices, lambda c: F.concat(F.lit(" "), F.trim(c)))
    return [key.alias("id"), nfc(context).alias("context"), nfc_all(refuse(good, "malformed item", spaced, "array<string>")).alias("choices"), gold.cast("long").alias("gold")]


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfc_all(a: pd.Series) -> pd.Series:
    import unicodedata

    return a.map(lambda xs: None if xs is None else [unicodedata.normalize("NFC", x) for x in xs])


def invalid_reading(records: DataFrame) -> DataFrame:
    """Records that lack one of the seven fields or whose answer is not 1 to 4."""
    ok = F.col("correct_answer_num").isin("1", "2", "3", "4")
    for f in READING_FIELDS:
        ok = ok & F.col(f).isNotNull()
    return records.filter(~F.coalesce(ok, F.lit(False)))


def reading_items(records: DataFrame, pos: str) -> DataFrame:
    """Passage, question and four answers, the right one by its number; an invalid record fails."""
    prompt = F.concat("flores_passage", F.lit(f"\n{QUESTION}: "), "question", F.lit(f"\n{ANSWER}:"))
    answers = F.array(*[F.col(f"mc_answer{k}") for k in range(1, 5)])
    number = refuse(F.col("correct_answer_num").isin("1", "2", "3", "4") & F.forall(answers, lambda a: a.isNotNull()), "not a reading item", F.col("correct_answer_num").cast("int"), "int")
    return records.select(*item(F.concat(F.lit("belebele-"), F.col(pos).cast("string")), prompt, answers, number - 1))


def letter_items(records: DataFrame, pos: str, prefix: str, question: str, before: str = "", after: str = "") -> DataFrame:
    """Four options and a letter; records without four options or with another answer are left out. The id is the record's, its sample's or its place."""
    options = F.array(*[F.col(f"option_{c}") for c in "abcd"])
    names = [F.col(c).cast("string") for c in ("id", "sample_id") if c in records.columns]
    whole = F.coalesce(F.col("answer").isin(*LETTERS), F.lit(False)) & F.forall(options, lambda o: F.coalesce(F.trim(o) != "", F.lit(False)))
    key = F.concat(F.lit(f"{prefix}-"), F.coalesce(*names, F.col(pos).cast("string")))
    return records.filter(whole).select(*item(key, F.concat(F.lit(before), F.col(question), F.lit(after)), options, F.instr(F.lit(LETTERS), F.col("answer")) - 1))


def entailment_items(records: DataFrame, pos: str) -> DataFrame:
    """A premise without its full stops, a tag question, and three continuations by a word and the hypothesis."""
    context = F.concat(F.regexp_replace(F.trim("premise"), r"\.+$", ""), F.lit(f", {TAG}"))
    choices = F.array(*[F.concat(F.lit(f" {w}, "), F.trim("hypothesis")) for w in VERBALIZERS])
    return records.select(*item(F.concat(F.lit("xnli-"), F.col(pos).cast("string")), context, choices, F.col("label").cast("int")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def string_list(text: pd.Series) -> pd.Series:
    """A list written as JSON or as a Python literal; null for anything else."""

    def read(x):
        for parse in (json.loads, ast.literal_eval):
            try:
                got = parse(x)
            except (TypeError, ValueError, SyntaxError):
                continue
            if isinstance(got, (list, tuple)):
                return [str(y) for y in got]
        return None

    return text.map(read)


def sentence_case(text: Column) -> Column:
    """The first character in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def ending_items(records: DataFrame, pos: str, prefix: str) -> DataFrame:
    """An activity, a context of two parts, four endings given as a list or as its text; records without four endings, a label of 0 to 3 or with a blank ending are left out."""
    endings = F.col("endings") if isinstance(records.schema["endings"].dataType, T.ArrayType) else string_list("endings")
    d = records.withColumn("_endings", endings)
    label = F.col("label").cast("string")
    d = d.filter((F.size("_endings") == 4) & label.isin("0", "1", "2", "3"))
    context = clean_markers(F.concat("activity_label", F.lit(": "), "ctx_a", F.lit(" "), sentence_case(F.coalesce("ctx_b", F.lit("")))))
    d = d.withColumn("_choices", F.transform("_endings", clean_markers)).filter(F.forall("_choices", lambda c: F.trim(c) != ""))
    index = F.coalesce(F.col("ind").cast("string"), F.lit("")) if "ind" in records.columns else F.lit("")
    return d.select(*item(F.concat_ws("-", F.lit(prefix), F.col(pos).cast("string"), index), context, F.col("_choices"), label.cast("int")))
