"""Prompt construction for identification, comparison and translation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ambilens.functions.text import as_column

# Prompt texts and answers. Results depend on every character.
IDENTIFICATION_TEMPLATES = {
    "default": (
        "请判断下面的句子/词组是否具有歧义。只回答“是”或“否”。\n\n句子：\n{sentence}"
    ),
    "cot": (
        "请判断下面的句子/词组是否具有歧义。请逐步思考，写出你的思考过程，"
        "在最后一行单独写出结论“是”或“否”。\n\n句子：\n{sentence}"
    ),
}
COMPARISON_TEMPLATES = {
    "default": (
        "下面有两个句子/词组，请判断哪个更容易引起歧义。只回答1或2。"
        "\n句子1：{sent_1}\n句子2：{sent_2}"
    ),
    "cot": (
        "下面有两个句子/词组，请判断哪个更容易引起歧义。请逐步思考，写出你的思考过程，"
        "在最后一行单独写出结论“1”或“2”。\n句子1：{sent_1}\n句子2：{sent_2}"
    ),
}
IDENTIFICATION_CHOICES = ("是", "否")
COMPARISON_CHOICES = ("1", "2")
TRANSLATION_INSTRUCTION = "Translate this from Chinese into English:"
ASSISTANT_PREFIX = 'English: "'


def template(templates: dict[str, str], style: str) -> str:
    if style not in templates:
        raise ValueError(f"Unknown prompt style {style!r}; known: {', '.join(templates)}")
    return templates[style]


def _fill(text: str, **slots: Column) -> Column:
    """Concatenate literal pieces and slot columns, in template order.

    Slot values are never scanned for further slots.
    """
    parts: list[Column] = []
    while text:
        found = [(text.find("{%s}" % name), name) for name in slots]
        at, name = min(((pos, name) for pos, name in found if pos >= 0), default=(-1, ""))
        if at < 0:
            parts.append(F.lit(text))
            break
        if at:
            parts.append(F.lit(text[:at]))
        parts.append(slots[name])
        text = text[at + len(name) + 2 :]
    return F.concat(*parts)


def identification_prompt(sentence: Column | str, style: str = "default") -> Column:
    text = template(IDENTIFICATION_TEMPLATES, style)
    return _fill(text, sentence=as_column(sentence))


def comparison_prompt(
    sentence_1: Column | str, sentence_2: Column | str, style: str = "default"
) -> Column:
    text = template(COMPARISON_TEMPLATES, style)
    return _fill(text, sent_1=as_column(sentence_1), sent_2=as_column(sentence_2))


def translation_prompt(
    source: Column | str,
    model_type: Column | str,
    render: Callable[[Column], Column] | None = None,
) -> Column:
    """Base models continue the text; instruct models go through ``render``.

    ``render`` turns the user content into the model's chat text and may be any
    Column function, a pandas UDF included.
    """
    content = F.concat(
        F.lit(f'{TRANSLATION_INSTRUCTION}\nChinese: "'), as_column(source), F.lit('"')
    )
    base = F.concat(content, F.lit("\n"))
    if render is None:
        chat = F.raise_error(F.lit("An instruct model needs a render function"))
        chat = chat.cast("string")
    else:
        chat = render(content)
    opening = F.when(as_column(model_type) == "base", base).otherwise(chat)
    return F.concat(opening, F.lit(ASSISTANT_PREFIX))


def expected_answer(label: Column | str) -> Column:
    label = as_column(label)
    yes, no = IDENTIFICATION_CHOICES
    return F.when(label == 1, yes).when(label == 0, no)


def arranged_orders(ambiguous: Column | str, unambiguous: Column | str) -> Column:
    """Both presentation orders of a pair, for ``explode``."""
    first, second = as_column(ambiguous), as_column(unambiguous)

    def arranged(left: Column, right: Column, answer: str, order: str) -> Column:
        return F.struct(
            left.alias("sentence_1"),
            right.alias("sentence_2"),
            F.lit(answer).alias("expected_answer"),
            F.lit(order).alias("order"),
        )

    return F.array(
        arranged(first, second, "1", "original"),
        arranged(second, first, "2", "reversed"),
    )
