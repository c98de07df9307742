"""Typed questions: validation and resolution into specs. Configuration is small and lives on the driver."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

MAX_OPTIONS, MAX_LEVELS = 255, 10
TYPES, SCOPES = ("choice", "score", "noul"), ("chunk_local", "history_aware")

# ---- fixed values: the two question batteries ----
COMPRESSION = [
    {"id": "concerns", "type": "choice", "text": "Which character does this passage primarily concern?", "options": "roster", "extra_options": ["none", "multiple"]},
    {"id": "secondary", "type": "choice", "text": "Which character, other than the one this passage primarily concerns, does it concern most?", "options": "roster", "extra_options": ["none"]},
    {"id": "event_type", "type": "choice", "text": "What kind of event mainly happens in this passage of a detective story?",
     "options": ["discovery", "testimony", "accusation", "alibi_claim", "alibi_broken", "physical_evidence", "movement", "background", "misdirection", "none"]},
    {"id": "new_evidence", "type": "noul", "text": "Does this passage present a piece of evidence or a clue relevant to the crime?"},
    {"id": "time_reference", "type": "noul", "text": "Does this passage state or clearly imply a specific time or time of day at which something happened?"},
    {"id": "location_stated", "type": "noul", "text": "Does this passage state a specific place where a character was or where something happened?"},
    {"id": "suspicion", "type": "score", "per_character": True, "text": "How suspicious is {name}'s behaviour in this passage?",
     "levels": ["Absent from this passage, or nothing suspicious about their behaviour in it", "Slightly odd or evasive behaviour, easily explained", "Noticeably suspicious: a lie, a gap, or a motive surfaces",
                "Strongly suspicious: behaviour points toward guilt", "Extremely suspicious: behaviour nearly implicates them in the crime"]},
    {"id": "key_sentence", "type": "choice", "text": "Which sentence in this passage matters most for working out who committed the crime?", "options": "sentences"},
]
INFERENCE = [
    {"id": "culprit", "type": "choice", "text": "Based on everything read so far, who committed the crime?", "options": "candidates", "extra_options": ["none_of_these"]},
    {"id": "contradicts_prior", "type": "noul", "text": "Does the CURRENT PASSAGE contradict something from earlier in the story (in the CASE NOTES or RECENT PASSAGES)?"},
    {"id": "alibi_effect", "type": "choice", "text": "What does the CURRENT PASSAGE do to any character's alibi, compared with what the CASE NOTES record?", "options": ["established", "weakened", "none"]},
    {"id": "culprit_revealed", "type": "noul", "text": "Has the story, up to and including the CURRENT PASSAGE, explicitly revealed who committed the crime? For example: a confession, the detective naming the culprit with the proof, or the culprit being caught in the act. Suspicion, accusations, or guesses do not count."},
]
# ---- end of fixed values ----
for _q in COMPRESSION:
    _q["scope"] = "chunk_local"
for _q in INFERENCE:
    _q["scope"] = "history_aware"


class QuestionError(ValueError):
    pass


@dataclass(frozen=True)
class Spec:
    """A question ready to ask. options are (label, description) in the order sent, which is part of its identity."""

    id: str
    type: str
    instructions: str
    options: tuple[tuple[str, str | None], ...] = ()
    template: str = ""
    character: str | None = None


def check(q: dict, scope: str) -> None:
    """Raises on the first fault of one question."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise QuestionError(f"{q.get('id')!r}: {what}")

    need(isinstance(q.get("id"), str) and bool(re.fullmatch(r"[a-z0-9]+(?:_[a-z0-9]+)*", q["id"])), "an id of small letters, digits and single _ between them is needed")
    need(q.get("scope") == scope, f"its scope isn't {scope}")
    need(q.get("type") in TYPES, f"its type must be one of {TYPES}")
    need(isinstance(q.get("text"), str) and bool(q["text"].strip()), "a text is needed")
    per = bool(q.get("per_character"))
    need(not per or "{name}" in q["text"], "a question per character must name it as {name}")
    need(not per or q["type"] != "choice", "a choice can't be per character")
    if q["type"] == "score":
        levels = q.get("levels")
        need(isinstance(levels, list) and 2 <= len(levels) <= MAX_LEVELS and all(isinstance(x, str) for x in levels), f"2 to {MAX_LEVELS} levels are needed")
    else:
        need("levels" not in q, "only scores have levels")
    if q["type"] == "choice":
        options = q.get("options")
        named = {"roster", "candidates", "sentences"}
        need(options in named if isinstance(options, str) else isinstance(options, list) and bool(options), "options must be a list or roster, candidates or sentences")
        need(scope == "history_aware" or options != "candidates", "candidates need history")
        need(scope == "chunk_local" or options != "sentences", "sentences belong to a chunk")
        need(not isinstance(options, list) or len(set(options)) == len(options), "an option is given twice")
    else:
        need("options" not in q and "extra_options" not in q, "only choices have options")


def validate(questions: list[dict], scope: str) -> list[dict]:
    """Raises on the first fault; gives the questions back."""
    if scope not in SCOPES:
        raise QuestionError(f"unknown scope {scope!r}")
    if not isinstance(questions, list) or not questions:
        raise QuestionError("a list of questions is needed")
    seen: set[str] = set()
    for q in questions:
        check(q, scope)
        if q["id"] in seen:
            raise QuestionError(f"{q['id']!r}: the id is used twice")
        seen.add(q["id"])
    if scope == "history_aware" and not any(q["id"] == "culprit" and q["type"] == "choice" for q in questions):
        raise QuestionError("the choice 'culprit' is needed")
    return questions


def questions_hash(questions: list[dict]) -> str:
    return hashlib.sha256(json.dumps(questions, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def character_ids(template: str, names: list[str]) -> dict[str, str]:
    """An id for each name; names with one slug get _2, _3 and so on."""
    out: dict[str, str] = {}
    for name in names:
        base = f"{template}__{re.sub('[^a-z0-9]+', '_', name.lower()).strip('_') or 'x'}"
        own = next(c for c in [base, *(f"{base}_{k}" for k in range(2, len(names) + 3))] if c not in out.values())
        out[name] = own
    return out


@dataclass
class Context:
    roster: list[dict]
    candidates: list[str] | None = None
    sentences: list[str] | None = None
    others: dict[str, str | None] = field(init=False)

    def __post_init__(self) -> None:
        self.others = {}
        for c in self.roster:
            rest = [n for n in dict.fromkeys(c.get("aliases", [])) if n and n != c["canonical"]]
            self.others[c["canonical"]] = f"also called: {', '.join(rest)}" if rest else None


def resolve(questions: list[dict], context: Context) -> list[Spec]:
    """Specs of a battery for one state: one for each character where asked, options filled in."""
    out: list[Spec] = []
    for q in questions:
        if q.get("per_character"):
            names = list(context.others) if q["scope"] == "chunk_local" else context.candidates
            if names is None:
                raise QuestionError(f"{q['id']!r} needs candidates")
            for name, own in character_ids(q["id"], names).items():
                out.append(Spec(own, q["type"], q["text"].replace("{name}", name), tuple((x, None) for x in q.get("levels", ())), q["id"], name))
        elif q["type"] != "choice":
            out.append(Spec(q["id"], q["type"], q["text"], tuple((x, None) for x in q.get("levels", ())), q["id"]))
        else:
            out.append(Spec(q["id"], "choice", q["text"], _options(q, context), q["id"]))
    return out


def _options(q: dict, context: Context) -> tuple[tuple[str, str | None], ...]:
    source = q["options"]
    if source == "roster":
        options = list(context.others.items())
    elif source == "candidates":
        if context.candidates is None:
            raise QuestionError(f"{q['id']!r} needs candidates")
        options = [(n, context.others.get(n)) for n in context.candidates]
    elif source == "sentences":
        if context.sentences is None:
            raise QuestionError(f"{q['id']!r} needs sentences")
        options = [(f"s{i}", s) for i, s in enumerate(context.sentences, 1)]
    else:
        options = [(str(o), None) for o in source]
    extra = q.get("extra_options", [])
    for label, text in extra.items() if isinstance(extra, dict) else [(str(e), None) for e in extra]:
        if label in dict(options):
            raise QuestionError(f"{q['id']!r}: the extra option {label!r} is an option already")
        options.append((label, text))
    if not 1 <= len(options) <= MAX_OPTIONS:
        raise QuestionError(f"{q['id']!r}: {len(options)} options; 1 to {MAX_OPTIONS} are possible, and none are cut")
    return tuple(options)
