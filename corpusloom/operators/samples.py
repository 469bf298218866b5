"""Building training samples: multiple choice, captions, chats, prompts and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import seeded
from corpusloom.functions import text as T

AUDIO = "<audio>"
BEGIN, END = "<|seg|>", "<|/seg|>"
# Templates are configuration: own wording, replaceable by the caller.
MC_HEAD = AUDIO + "Listen, then choose the right option."
MC_TAIL = 'Answer with JSON only, like {"answer": "B"}'
SHORT_PROMPTS = ("Name the sounds.", "What is heard, in short?")
LONG_PROMPTS = ("Describe the recording in full.", "Tell all that can be heard.", "Give a detailed account of the audio.")

_OPTION = "array<struct<content:string,is_correct:boolean>>"


def options(raw: Column, answer_index: Column, answer_label: Column) -> Column:
    """Options as an array of (content, is_correct) from any of the three encodings in JSON.

    Texts with an index of the answer, objects with a label, or objects that say whether they are correct. The first
    element tells which. Null or unreadable JSON gives null, an empty list stays empty.
    """
    v = F.try_parse_json(raw)
    items = F.try_variant_get(v, "$", "array<variant>")
    first = F.get(items, F.lit(0))
    objects = F.schema_of_variant(first).startswith("OBJECT")
    flagged = F.exists(items, lambda o: F.try_variant_get(o, "$.is_correct", "boolean").isNotNull())

    def option(o: Column, i: Column) -> Column:
        content = F.when(objects, F.try_variant_get(o, "$.content", "string")).otherwise(F.try_variant_get(o, "$", "string"))
        label = F.coalesce(F.try_variant_get(o, "$.label", "string"), F.lit("")) == F.coalesce(answer_label, F.lit(""))
        correct = F.when(objects & flagged, F.coalesce(F.try_variant_get(o, "$.is_correct", "boolean"), F.lit(False))).when(objects, label).otherwise(F.coalesce(answer_index == i, F.lit(False)))
        return F.struct(content.alias("content"), correct.alias("is_correct"))

    return F.when(items.isNotNull() & (F.size(items) == 0), F.array().cast(_OPTION)).otherwise(F.transform(items, option))


def right_label(opts: Column) -> Column:
    """Label of the correct option, of the last one if there are several; null if there is none."""
    marked = F.filter(F.transform(opts, lambda o, i: F.struct(o.is_correct.alias("ok"), T.option_label(i).alias("label"))), lambda s: s.ok)
    return F.try_element_at(marked, F.lit(-1)).label


def mc_prompt(question: Column, opts: Column) -> Column:
    lines = F.transform(opts, lambda o, i: F.concat(F.lit("Option "), T.option_label(i), F.lit(": "), F.coalesce(o.content, F.lit(""))))
    return F.array_join(F.concat(F.array(F.lit(MC_HEAD), F.concat(F.lit("Question: "), T.strip(question)), F.lit("Choices:")), lines, F.array(F.lit(""), F.lit(MC_TAIL))), "\n")


def mc_answer(label: Column) -> Column:
    """One-key JSON with a blank behind the colon."""
    return F.concat(F.lit('{"answer": "'), label, F.lit('"}'))


def mc_line(question: Column, opts: Column) -> Column:
    """Question and lettered options in one line."""
    shown = F.transform(opts, lambda o, i: F.concat(T.option_label(i, bounded=False), F.lit(". "), o))
    return F.concat_ws(" ", F.coalesce(question, F.lit("")), F.array_join(shown, " "))


def clean_captions(captions: Column) -> Column:
    """Captions stripped, without null and blank ones; null stays null."""
    return F.filter(F.transform(captions, T.strip), lambda c: c.isNotNull() & (c != ""))


def caption(long: Column, short: Column, style: str, *key) -> Column:
    """(prompt, caption) by style ``long``, ``short`` or ``both`` (also ``mix``); null where a caption is missing.

    ``both`` takes long or short at even odds, with a prompt of its kind; the other styles leave the prompt null.
    """
    if style in ("long", "short"):
        c = clean_captions(long if style == "long" else short)
        return F.struct(F.lit(None).cast("string").alias("prompt"), seeded.pick(c, *key).alias("caption"))
    if style not in ("both", "mix"):
        raise ValueError(f"no caption style {style!r}")
    use_short = seeded.uniform(*key, "kind") < 0.5
    pools = [F.array(*map(F.lit, p)) for p in (SHORT_PROMPTS, LONG_PROMPTS)]
    prompt = F.when(use_short, seeded.pick(pools[0], *key, "prompt")).otherwise(seeded.pick(pools[1], *key, "prompt"))
    chosen = F.when(use_short, seeded.pick(clean_captions(short), *key)).otherwise(seeded.pick(clean_captions(long), *key))
    whole = long.isNotNull() & short.isNotNull()
    return F.struct(F.when(whole, F.concat(F.lit(AUDIO), prompt)).alias("prompt"), F.when(whole, chosen).alias("caption"))


def is_valid_chat(messages: Column) -> Column:
    """Two turns, the placeholder in the first; null is not valid."""
    return F.coalesce((F.size(messages) == 2) & F.coalesce(F.get(messages, F.lit(0)).content.contains(AUDIO), F.lit(False)), F.lit(False))


def punctuated(messages: Column) -> Column:
    """Every turn with a full stop where it lacks an end; null contents stay null."""
    return F.transform(messages, lambda m: F.struct(m.role.alias("role"), T.punctuate(m.content).alias("content")))


def expand(text: Column, chunks: Column, begin: str = BEGIN, end: str = END) -> Column:
    """The k-th placeholder becomes the begin marker, once per chunk of the k-th audio, and an end marker."""
    return T.replace_each(text, AUDIO, F.transform(chunks, lambda n: F.concat(F.repeat(F.lit(begin), n.cast("int")), F.lit(end))))


def prompt_for(task: Column, question: Column, template: Column, default: str, passing: tuple[str, ...], slots: dict[str, str]) -> Column:
    """Prompt of a test item: its own question for passing tasks, a slot template, the table's prompt or a default."""
    q = F.coalesce(question, F.lit(""))
    out = F.coalesce(template, F.lit(default))
    for name, text in slots.items():
        out = F.when(task == name, T.slot(text, q)).otherwise(out)
    return F.when(task.isin(*passing), q).otherwise(out)


def prompt_prefix(n_audio: Column, prompt: Column) -> Column:
    """A placeholder per audio in front of the prompt."""
    return F.concat(F.repeat(F.lit(AUDIO), n_audio.cast("int")), prompt)
