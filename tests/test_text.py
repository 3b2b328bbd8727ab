"""Text functions against plain Python statements of the same semantics."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ambilens.functions import names, prompts, text

ALPHABET = ['"', "\n", " ", "　", "\u0085", "\x1c", "\t", "a", "b", "é", "Note: ", "Note:", "1", "2",
            "是", "否", "的", "。", "_", "-", "ß", "٣", "😀"]


def sample(seed, n=1500, longest=12):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def cleaned(value):
    if value is None:
        return ""

    def unquoted(t):
        return t[:-1].strip() if t.endswith('"') else t

    line = unquoted(value.strip())
    if "\n" in line:
        line = unquoted(line.partition("\n")[0].strip())
    return line.partition("Note: ")[0].strip()


def answer(response, choices):
    options = "|".join(map(re.escape, sorted(choices, key=len, reverse=True)))
    alone = re.findall(rf"(?<!\w)({options})(?!\w)", response)
    if alone:
        return alone[-1]
    return response.strip() if response.strip() in choices else None


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def pairs_of(df, column):
    return [(row.v, row.r) for row in df.select("v", column.alias("r")).collect()]


def test_whitespace_is_pythons():
    every = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(text.WHITESPACE) == every


def test_strip_and_blank(spark):
    df = frame(spark, sample(1) + [None])
    for value, got in pairs_of(df, text.strip("v")):
        assert got == (None if value is None else value.strip())
    for value, got in pairs_of(df, text.is_blank("v")):
        assert got == (value is None or not value.strip())


@pytest.mark.parametrize("seed", [2, 3])
def test_clean_translation(spark, seed):
    corner = [None, "", '"', '""', 'a"\n"', 'a"\n" ', '\n"', 'a\n""', 'a\n\n"', "a\n \n", 'a" \nb',
              "Note: x", "a Note: b Note: c", 'x"\n"\n"', ' "\n" \n']
    for value, got in pairs_of(frame(spark, sample(seed, 3000) + corner), text.clean_translation("v")):
        assert got == cleaned(value), repr(value)


@pytest.mark.parametrize("choices", [("是", "否"), ("1", "2"), ("ab", "b"), ("a-", "-")])
def test_parse_answer(spark, choices):
    values = sample(4, 3000)
    for value, got in pairs_of(frame(spark, values), text.parse_answer("v", choices)):
        assert got == answer(value, choices), repr(value)


def test_token_choice(spark):
    for value, got in pairs_of(frame(spark, sample(5, 500, 3)), text.token_choice("v", ("是", "1"))):
        assert got == (value.strip() if value.strip() in ("是", "1") else None)


def slug(model):
    name = model.rstrip("/").split("/")[-1].lower()
    return re.sub(r"_+", "_", "".join(c if c.isalnum() else "_" for c in name)).strip("_")


def test_model_names(spark):
    models = ["org/Qwen3-8B", "Qwen3-8B-Base/", "/m/qwen2.5-7b", "Qwen2.5-7B-INSTRUCT", "org/É-x//",
              "a--b", "Llama"]
    df = frame(spark, models)
    kinds = dict(pairs_of(df, names.infer_model_type("v")))
    assert [kinds[m] for m in models] == [
        "instruct", "base", "base", "instruct", None, None, None]
    assert dict(pairs_of(df, names.model_slug("v"))) == {m: slug(m) for m in models}
    tags = dict(pairs_of(df, names.model_tag("v")))
    assert tags["Qwen2.5-7B-INSTRUCT"] == "qwen2.5_7b_instruct" and tags["org/É-x//"] == "é_x"
    reports = dict(pairs_of(df, names.report_name("v", thinking=True)))
    assert reports["org/Qwen3-8B"] == "Qwen3-8B_thinking"
    assert set(dict(pairs_of(df, names.infer_model_type("v", "base"))).values()) == {"base"}


def test_model_type_needs_a_hint(spark):
    df = frame(spark, ["Llama"])
    assert pairs_of(df, names.resolve_model_type("v", True)) == [("Llama", "instruct")]
    with pytest.raises(Exception, match="Cannot tell"):
        pairs_of(df, names.resolve_model_type("v", False))
    with pytest.raises(Exception, match="No directory name"):
        pairs_of(frame(spark, ["--/"]), names.model_slug("v"))


def test_prompts_fill_slots_once(spark):
    df = frame(spark, ["{sentence}", "{sent_2}"])
    for style, shape in prompts.IDENTIFICATION_TEMPLATES.items():
        for value, got in pairs_of(df, prompts.identification_prompt("v", style)):
            assert got == shape.format(sentence=value)
    for style, shape in prompts.COMPARISON_TEMPLATES.items():
        for value, got in pairs_of(df, prompts.comparison_prompt("v", F.lit("z"), style)):
            assert got == shape.format(sent_1=value, sent_2="z")
    with pytest.raises(ValueError, match="default, cot"):
        prompts.identification_prompt("v", "other")


def test_translation_prompt(spark):
    df = frame(spark, ["字"])
    content = 'Translate this from Chinese into English:\nChinese: "字"'
    assert pairs_of(df, prompts.translation_prompt("v", F.lit("base"))) == [
        ("字", content + '\nEnglish: "')]
    render = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    assert pairs_of(df, prompts.translation_prompt("v", F.lit("instruct"), render)) == [
        ("字", f'<{content}>English: "')]
    with pytest.raises(Exception, match="render"):
        pairs_of(df, prompts.translation_prompt("v", F.lit("instruct")))
