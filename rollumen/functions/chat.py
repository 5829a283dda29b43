"""Chat messages: templates, segments, tool calls, loss masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conversation(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns (key, order, role, text) -> (key, messages), in order."""
    m = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("role"), F.col("text").alias("content"))))
    return turns.groupBy(key).agg(m.alias("m")).select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def rendered(messages: Column, generate: bool = False) -> Column:
    """<|im_start|>role ... <|im_end|> for each message; generate opens an assistant's turn."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))
    return F.concat(F.array_join(F.transform(messages, one), ""), F.lit("<|im_start|>assistant\n" if generate else ""))


@dataclass(frozen=True)
class Template:
    """How a model family writes a conversation. head has {role}; default: a system message for conversations that begin with none."""

    head: str
    tail: str
    begin: str = ""
    default: str | None = None

    def opened(self, role: str) -> str:
        return self.head.format(role=role)

    def text(self, messages: list[dict], generate: bool = False) -> str:
        """One conversation as text, on the driver."""
        first = [] if self.default is None or (messages and messages[0]["role"] == "system") else [{"role": "system", "content": self.default}]
        said = "".join(self.opened(m["role"]) + (m["content"] or "") + self.tail for m in [*first, *messages])
        return self.begin + said + (self.opened("assistant") if generate else "")

    def prompts(self) -> tuple[str, str]:
        """(what stands before a conversation's first turn, what opens an answer), told apart by conversations of one and of two empty turns."""
        turn = {"role": "user", "content": ""}
        one, two, asked = self.text([turn]), self.text([turn] * 2), self.text([turn], True)
        return one[: len(one) - (len(two) - len(one))], asked[len(one) :]


# Formats of model families.
TEMPLATES = {
    "chatml": Template("<|im_start|>{role}\n", "<|im_end|>\n"),
    "chatml_assistant": Template("<|im_start|>{role}\n", "<|im_end|>\n", default="You are a helpful assistant."),
    "header": Template("<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", begin="<|begin_of_text|>"),
    "turns": Template("<start_of_turn>{role}\n", "<end_of_turn>\n", begin="<bos>"),
}


def template(name: str | Template) -> Template:
    """A template by name, or one's own."""
    if isinstance(name, Template):
        return name
    if name not in TEMPLATES:
        raise ValueError(f"no template {name}; there are {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[name]


def applied(messages: Column, name: str | Template, generate: bool = False, continued: bool = False) -> Column:
    """Conversations by a template; continued: turns that go on after others, without what stands before the first one. Null roles and contents are empty."""
    t = template(name)
    left, right = t.head.split("{role}")
    one = lambda m: F.concat(F.lit(left), F.coalesce(m["role"], F.lit("")), F.lit(right), F.coalesce(m["content"], F.lit("")), F.lit(t.tail))
    said = F.array_join(F.transform(messages, one), "")
    if not continued:
        begin = F.lit(t.begin)
        if t.default is not None:
            none = F.coalesce(F.get(messages, F.lit(0))["role"] != "system", F.lit(True))
            begin = F.concat(begin, F.when(none, t.opened("system") + t.default + t.tail).otherwise(""))
        said = F.concat(begin, said)
    return F.concat(said, F.lit(t.opened("assistant"))) if generate else said


def loss_segments(messages: Column) -> Column:
    """array<struct<text, learn>>: what assistants write is learnt, headers and other roles are not."""

    def one(m: Column) -> Column:
        head = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"))
        body = F.concat(F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))
        seg = lambda t, on: F.struct(t.alias("text"), F.lit(on).alias("learn"))
        return F.when(m["role"] == "assistant", F.array(seg(head, 0), seg(body, 1))).otherwise(F.array(seg(F.concat(head, body), 0)))

    return F.flatten(F.transform(messages, one))


def segments(content: Column) -> Column:
    """Text and <image>/<video> placeholders, one after the other; empty texts are dropped."""
    return F.filter(F.regexp_extract_all(content, F.lit(r"(?s)(<image>|<video>|(?:(?!<image>|<video>).)+)"), F.lit(1)), lambda x: x != "")


def checked_segments(content: Column, images: Column, videos: Column) -> Column:
    """segments(), or an error if placeholders and media differ in number."""
    parts = segments(content)
    count = lambda k: F.size(F.filter(parts, lambda x: x == k))
    ok = (count("<image>") == images) & (count("<video>") == videos)
    return F.filter(parts, lambda x: F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("placeholders and media differ in number")).cast("boolean")))


def parts_to_text(parts: Column) -> Column:
    """array<struct<type, text>> as one text, with placeholders for images and videos."""
    one = lambda p: F.when(p["type"] == "image", "<image>").when(p["type"] == "video", "<video>").otherwise(F.coalesce(p["text"], F.lit("")))
    return F.array_join(F.transform(parts, one), "")


def with_teacher_images(content: Column, teacher: Column) -> Column:
    """The k-th <image> becomes <image:path> of the k-th teacher image; different counts are an error."""
    pieces = F.split(content, "<image>", -1)
    same = F.size(pieces) - 1 == F.size(teacher)
    joined = F.array_join(F.transform(pieces, lambda x, i: F.when(i < F.size(teacher), F.concat(x, F.lit("<image:"), F.get(teacher, i), F.lit(">"))).otherwise(x)), "")
    return F.when(same, joined).otherwise(F.raise_error(F.lit("images and teacher images differ in number")).cast("string"))


TOOL_CALL = r"(?s)<tool_call>(.*?)</tool_call>"


def tool_calls(text: Column) -> Column:
    """struct<content, calls array<struct<name, arguments>>>; arguments stay JSON text, broken calls are skipped."""
    raw = F.regexp_extract_all(text, F.lit(TOOL_CALL), F.lit(1))
    parsed = F.transform(raw, lambda x: F.from_json(x, "struct<name: string, arguments: string>"))
    good = F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())
    return F.struct(F.regexp_replace(text, TOOL_CALL, "").alias("content"), good.alias("calls"))


def channel_tool_calls(text: Column) -> Column:
    """As tool_calls, for calls in the form of channels; analysis is dropped first."""
    for p in (r"(?s)<\|start\|>assistant<\|channel\|>analysis<\|message\|>.*?<\|end\|>", r"(?s)<\|channel\|>analysis<\|message\|>.*?<\|end\|>"):
        text = F.regexp_replace(text, p, "")
    call = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
    names, args = (F.regexp_extract_all(text, F.lit(call), F.lit(k)) for k in (1, 2))
    return F.struct(F.regexp_replace(text, call, "").alias("content"), F.zip_with(names, args, lambda n, a: F.struct(n.alias("name"), a.alias("arguments"))).alias("calls"))


PARSERS = {"hermes": tool_calls, "gpt-oss": channel_tool_calls}


def last_assistant(messages: Column) -> Column:
    """The last assistant message's content; '' without one."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.coalesce(F.try_element_at(own, F.lit(-1))["content"], F.lit(""))


def turn_states(roles: Column) -> Column:
    """The states that a conversation goes through: generating for an assistant's turn, tools or interaction between."""
    one = lambda r: F.when(r == "assistant", "generating").when(r == "tool", "processing_tools").when(r == "user", "interacting").otherwise("pending")
    return F.concat(F.array(F.lit("pending")), F.transform(roles, one), F.array(F.lit("terminated")))


def response_masks(lengths: Column, roles: Column) -> Column:
    """1 for tokens of assistants, 0 for those of tools and users, turn by turn."""
    return F.flatten(F.zip_with(lengths, roles, lambda n, r: F.array_repeat(F.when(r == "assistant", 1).otherwise(0), n)))


def teacher_prompt(question: Column, solution: Column, feedback: Column, only_without_solution: bool = True) -> Column:
    """The question with a correct solution, and feedback on an earlier attempt (only without a solution, on request)."""
    none = F.lit("")
    has = F.coalesce(F.length(solution) > 0, F.lit(False))
    a = F.when(has, F.concat(F.lit("\n\nCorrect solution:\n\n"), solution)).otherwise(none)
    use = (~has if only_without_solution else F.lit(True)) & F.coalesce(F.length(feedback) > 0, F.lit(False))
    b = F.when(use, F.concat(F.lit("\n\nFeedback on an earlier attempt:\n\n"), feedback)).otherwise(none)
    return F.concat(question, a, b)


def teacher_sequence(prompt: Column, response: Column, prompt_mask: Column, response_mask: Column) -> Column:
    """struct<ids, mask, start, positions>: the response after the teacher's prompt; positions go on from the last one."""
    last = F.aggregate(prompt_mask, F.lit(0), lambda s, x: s + x.cast("int")) - 1
    heads = F.transform(F.sequence(F.lit(1), F.size(prompt_mask)), lambda i: F.greatest(F.aggregate(F.slice(prompt_mask, F.lit(1), i), F.lit(0), lambda s, x: s + x.cast("int")) - 1, F.lit(0)))
    return F.struct(
        F.concat(prompt, response).alias("ids"), F.concat(prompt_mask, response_mask).alias("mask"), F.size(prompt).alias("start"),
        F.concat(heads, F.transform(response, lambda x, i: last + 1 + i)).alias("positions"),
    )
