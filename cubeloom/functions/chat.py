"""Chat templates: a style, two role names, two separators, a system text, and example turns that open every dialogue."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    style: str
    roles: tuple[str, str] = ("", "")
    sep: str = "\n"
    sep2: str = ""
    system: str = ""
    #: Values of human and gpt in turn.
    examples: tuple[str, ...] = ()


# The texts, names and separators of the named templates.
_HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
_USER = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_TAGGED = "A chat between a curious user and an artificial intelligence assistant. The assistant is able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language.The visual content will be provided with the following format: <Image>visual content</Image>."
_VISION = "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
_SAFE = """You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.

If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."""
_ENERGY = (
    "What are the key differences between renewable and non-renewable energy sources?",
    """Renewable energy sources are those that can be replenished naturally in a relatively short amount of time, such as solar, wind, hydro, geothermal, and biomass. Non-renewable energy sources, on the other hand, are finite and will eventually be depleted, such as coal, oil, and natural gas. Here are some key differences between renewable and non-renewable energy sources:
1. Availability: Renewable energy sources are virtually inexhaustible, while non-renewable energy sources are finite and will eventually run out.
2. Environmental impact: Renewable energy sources have a much lower environmental impact than non-renewable sources, which can lead to air and water pollution, greenhouse gas emissions, and other negative effects.
3. Cost: Renewable energy sources can be more expensive to initially set up, but they typically have lower operational costs than non-renewable sources.
4. Reliability: Renewable energy sources are often more reliable and can be used in more remote locations than non-renewable sources.
5. Flexibility: Renewable energy sources are often more flexible and can be adapted to different situations and needs, while non-renewable sources are more rigid and inflexible.
6. Sustainability: Renewable energy sources are more sustainable over the long term, while non-renewable sources are not, and their depletion can lead to economic and social instability.
""",
)
_IM = ("<|im_start|>user\n", "<|im_start|>assistant\n")
_V0 = Template("single", ("Human", "Assistant"), "###", system=_HUMAN)
_OPENED = replace(_V0, examples=_ENERGY)
_V1 = Template("two", ("USER", "ASSISTANT"), " ", "</s>", _USER)
_LLAMA_2 = Template("llama_2", ("USER", "ASSISTANT"), "<s>", "</s>", _SAFE)
_PLAIN = Template("plain", sep="\n")
_CHATML = Template("mpt", _IM, "<|im_end|>", system="<|im_start|>system\nAnswer the questions.")
TEMPLATES = {
    "default": _OPENED,
    "v0": _OPENED,
    "v1": _V1,
    "vicuna_v1": _V1,
    "llama_2": _LLAMA_2,
    "mistral_instruct": replace(_LLAMA_2, sep="", system=""),
    "chatml_direct": _CHATML,
    "mistral_direct": _CHATML,
    "plain": _PLAIN,
    "v0_plain": _PLAIN,
    "llava_v0": _V0,
    "v0_mmtag": replace(_V0, system=_TAGGED),
    "llava_v1": replace(_V1, system=_HUMAN),
    "v1_mmtag": replace(_V1, system=_TAGGED),
    "llava_llama_2": replace(_LLAMA_2, system=_VISION),
    "mpt": Template("mpt", _IM, "<|im_end|>", system="<|im_start|>system\nA conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers."),
    "plain_guided": _PLAIN,
    "llama_3_chat": Template("llama_3", ("<|start_header_id|>user<|end_header_id|>\n\n", "<|start_header_id|>system<|end_header_id|>\n\n"), "<|eot_id|>"),
    "qwen2": Template("qwen2", _IM, "<|im_end|>\n"),
    "interleave": _PLAIN,
}
STYLES = ("single", "two", "mpt", "llama_2", "llama_3", "qwen2", "plain")


def render(template: Template, turns: Column, system: str | None = None) -> Column:
    """A dialogue (array of struct from, value; roles human and gpt) as one prompt.

    An empty value leaves the role's name, open for an answer. Separators of two and plain, and the
    wrapping of llama_2, go by the turn's place, not its role."""
    t, system = template, template.system if system is None else system
    if t.examples:
        opening = [F.struct(F.lit(("human", "gpt")[i % 2]).alias("from"), F.lit(v).alias("value")) for i, v in enumerate(t.examples)]
        turns = F.concat(F.array(*opening), F.transform(turns, lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))))
    name = lambda x: F.when(x["from"] == "human", F.lit(t.roles[0])).otherwise(F.lit(t.roles[1]))
    blank = lambda x: F.coalesce(x["value"], F.lit("")) == ""
    by_place = lambda i: F.when(i % 2 == 0, F.lit(t.sep)).otherwise(F.lit(t.sep2))
    joined = lambda f: F.array_join(F.transform(turns, f), "")
    head = F.lit(system + t.sep)
    match t.style:
        case "single":
            return F.concat(head, joined(lambda x: F.concat(name(x), F.when(blank(x), F.lit(":")).otherwise(F.concat(F.lit(": "), x["value"], F.lit(t.sep))))))
        case "two":
            return F.concat(head, joined(lambda x, i: F.concat(name(x), F.when(blank(x), F.lit(":")).otherwise(F.concat(F.lit(": "), x["value"], by_place(i))))))
        case "mpt":
            return F.concat(head, joined(lambda x: F.concat(name(x), F.when(blank(x), F.lit("")).otherwise(F.concat(x["value"], F.lit(t.sep))))))
        case "llama_3" | "qwen2":
            head = head if system else F.lit("")
            return F.concat(head, joined(lambda x: F.concat(name(x), F.when(blank(x), F.lit("")).otherwise(F.concat(x["value"], F.lit(t.sep))))))
        case "llama_2":
            first = F.lit(f"<<SYS>>\n{system}\n<</SYS>>\n\n" if system else "")
            asked = lambda x, i: F.concat(F.lit(t.sep + "[INST] "), F.when(i == 0, first).otherwise(F.lit("")), x["value"], F.lit(" [/INST]"))
            said = lambda x: F.concat(F.lit(" "), x["value"], F.lit(" " + t.sep2))
            whole = joined(lambda x, i: F.when(blank(x), F.lit("")).when(i % 2 == 0, asked(x, i)).otherwise(said(x)))
            return F.call_function("ltrim", F.lit(t.sep), whole) if t.sep else whole  # leading characters of the separator go
        case "plain":
            return F.concat(F.lit(system), joined(lambda x, i: F.when(blank(x), F.lit("")).otherwise(F.concat(x["value"], by_place(i)))))
    raise ValueError(f"unknown chat style: {t.style}")
