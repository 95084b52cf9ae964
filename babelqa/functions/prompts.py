"""Prompt text, chat messages and chat rendering as Column expressions.

Messages are ``ARRAY<STRUCT<role STRING, content STRING>>``. Rendering uses the
higher-order functions ``filter`` / ``transform`` / ``array_join`` so it stays inside
whole-stage code generation. ``concat`` is used instead of ``format_string`` because
user text may contain ``%``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c) -> Column:
    if c is None:
        return F.lit(None).cast("string")
    return F.col(c) if isinstance(c, str) else c


def _str(c) -> Column:
    return F.lit(c) if isinstance(c, str) else _col(c)


def message(role, content) -> Column:
    return F.struct(_str(role).alias("role"), _col(content).cast("string").alias("content"))


def _fill(template: str, **values) -> Column:
    """A text template with ``{name}`` places filled by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def student_prompt(question, language=None, country=None) -> Column:
    """Question wrapped in the student template when a language or a country is given
    (country is accepted but not shown); otherwise the bare question."""
    q = _col(question)
    lang = F.coalesce(_col(language), F.lit(""))
    ctry = F.coalesce(_col(country), F.lit(""))
    wrapped = _fill(K.STUDENT_TEMPLATE, language=lang, question=q)
    return F.when((lang != "") | (ctry != ""), wrapped).otherwise(q)


def teacher_prompt(question, language, country, golden_answer) -> Column:
    return _fill(K.TEACHER_TEMPLATE, language=F.coalesce(_col(language), F.lit("")),
                 country=F.coalesce(_col(country), F.lit("")), question=_col(question), golden_answer=_col(golden_answer))


def question_messages(question, language=None, country=None, marker=K.ANSWER_MARKER,
                      system=K.SYSTEM_PROMPT) -> Column:
    """[system, user] plus an assistant turn holding ``marker`` when the marker is not
    NULL (an empty marker still appends the turn)."""
    base = [message("system", F.lit(system)), message("user", student_prompt(question, language, country))]
    if marker is None:
        return F.array(*base)
    if isinstance(marker, str):
        return F.array(*base, message("assistant", F.lit(marker)))
    m = _col(marker)
    return F.when(m.isNull(), F.array(*base)).otherwise(F.array(*base, message("assistant", m)))


def answer_messages(question, answer, language=None, country=None, marker=K.ANSWER_MARKER,
                    system=K.SYSTEM_PROMPT) -> Column:
    """[system, user, assistant]; the assistant content is ``marker + ' ' + answer``, or
    the bare answer when the marker is empty or NULL."""
    base = [message("system", F.lit(system)), message("user", student_prompt(question, language, country))]
    a = _col(answer)
    if marker is None or (isinstance(marker, str) and marker == ""):
        content = a
    elif isinstance(marker, str):
        content = F.concat(F.lit(marker + " "), a)
    else:
        m = _col(marker)
        content = F.when(m.isNull() | (m == ""), a).otherwise(F.concat(m, F.lit(" "), a))
    return F.array(*base, message("assistant", content))


@dataclass(frozen=True)
class ChatTemplate:
    """Turn-marker template; every field is data, so other templates are just values."""

    system_prompt: str = K.SYSTEM_PROMPT
    bos: str = K.BOS_TOKEN
    start_turn: str = K.START_TURN
    end_turn: str = K.END_TURN
    system_token: str = K.SYSTEM_TOKEN
    user_token: str = K.USER_TOKEN
    chatbot_token: str = K.CHATBOT_TOKEN
    response_start: str = K.RESPONSE_START
    response_end: str = K.RESPONSE_END

    def role_tokens(self) -> dict[str, str]:
        return {"system": self.system_token, "user": self.user_token, "assistant": self.chatbot_token}


DEFAULT_TEMPLATE = ChatTemplate()


def role_token(role, template: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    """Control token of a role; an unknown role fails the query."""
    r = _col(role)
    tokens = template.role_tokens()
    lookup = F.create_map(*[x for k, v in tokens.items() for x in (F.lit(k), F.lit(v))])
    tok = F.element_at(lookup, r)
    return F.when(tok.isNotNull(), tok).otherwise(
        F.raise_error(F.concat(F.lit("unknown chat role: "), F.coalesce(r, F.lit("NULL")))).cast("string"))


def render_chat(messages, template: ChatTemplate = DEFAULT_TEMPLATE, generation: bool = False) -> Column:
    """BOS + the template's own system turn, then every non-system message in turn
    markers (assistant content wrapped in response markers). With ``generation`` and a
    final user message, an assistant turn is opened."""
    t = template
    msgs = _col(messages)
    head = t.bos + t.start_turn + t.system_token + t.system_prompt + t.end_turn

    def turn(m):
        content = F.when(m["role"] == "assistant",
                         F.concat(F.lit(t.response_start), m["content"], F.lit(t.response_end))
                         ).otherwise(m["content"])
        return F.concat(F.lit(t.start_turn), role_token(m["role"], t), content, F.lit(t.end_turn))

    body = F.array_join(F.transform(F.filter(msgs, lambda m: m["role"] != "system"), turn), "")
    text = F.concat(F.lit(head), body)
    if not generation:
        return text
    last_role = F.element_at(msgs, -1)["role"]
    return F.when(last_role == "user",
                  F.concat(text, F.lit(t.start_turn + t.chatbot_token + t.response_start))).otherwise(text)


def drop_role(messages, role: str = "assistant") -> Column:
    return F.filter(_col(messages), lambda m: m["role"] != role)


def cut_after_marker(text, marker: str = K.ANSWER_MARKER) -> Column:
    """Keep the text up to and including the first occurrence of ``marker``; an absent
    marker fails the query."""
    t = _col(text)
    pos = F.instr(t, marker)
    return F.when(pos > 0, F.substring(t, F.lit(1), pos + F.lit(len(marker) - 1))).otherwise(
        F.raise_error(F.concat(F.lit(f"marker {marker!r} not found in prompt: "), F.coalesce(t, F.lit("NULL")))
                      ).cast("string"))


def append_marker(text, marker: str = K.ANSWER_MARKER) -> Column:
    """Validation-loop variant: the opened turn gets the marker appended."""
    return F.concat(_col(text), F.lit(marker))
