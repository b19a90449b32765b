"""The text form of requests."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from nearkin.config import EngineError

MODES = ("events", "vectors", "fusion")


@dataclass(frozen=True)
class Command:
    name: str
    args: dict = field(default_factory=dict)


def number(text: str, kind: type = float):
    try:
        value = kind(text)
    except ValueError:
        raise EngineError(f"no number: {text!r}") from None
    if not math.isfinite(value):
        raise EngineError(f"no finite number: {text!r}")
    return value


def option(word: str, known: tuple[str, ...]) -> tuple[str, str] | None:
    name, sign, value = word.partition("=")
    if not sign or not name.isidentifier():
        return None
    if name not in known:
        raise EngineError(f"unknown option: {name}")
    return name, value


def search_options(words: list[str], known: tuple[str, ...]) -> dict:
    out: dict = {}
    for word in words:
        pair = option(word, known)
        if pair is None:
            raise EngineError(f"unexpected: {word!r}")
        name, value = pair
        if name == "using" and value not in MODES:
            raise EngineError(f"using must be one of {', '.join(MODES)}")
        if name == "adaptive" and value not in ("on", "off"):
            raise EngineError("adaptive must be on or off")
        out[name] = number(value) if name == "min_score" else value == "on" if name == "adaptive" else value
    return out


def parse_sim(words: list[str]) -> dict:
    if len(words) < 2:
        raise EngineError("SIM needs an id and a number of results")
    return {"id": words[0], "k": number(words[1], int), **search_options(words[2:], ("using", "adaptive", "filter", "min_score"))}


def parse_simv(words: list[str]) -> dict:
    if not words:
        raise EngineError("SIMV needs a number of results")
    at = 1
    while at < len(words) and option(words[at], ("filter", "min_score")):
        at += 1
    if at == len(words):
        raise EngineError("SIMV needs a vector")
    return {"k": number(words[0], int), **search_options(words[1:at], ("filter", "min_score")), "vector": [number(w) for w in words[at:]]}


def parse_event(words: list[str]) -> dict:
    if len(words) < 3:
        raise EngineError("EVENT needs a context, a type and an item")
    ctx, kind, item, *rest = words
    kind = kind.upper()
    if kind not in ("ADD", "SET", "DEL"):
        raise EngineError(f"unknown event type: {kind}")
    score = 0
    if kind != "DEL":
        if not rest:
            raise EngineError(f"{kind} needs a score")
        score = number(rest.pop(0), int)
        if not 0 <= score <= 100:
            raise EngineError("a score must be from 0 to 100")
    ts = None
    for word in rest:
        pair = option(word, ("timestamp",))
        if pair is None:
            raise EngineError(f"unexpected: {word!r}")
        ts = number(pair[1], int)
    return {"ctx": ctx, "type": kind, "item_id": item, "score": score, "ts": ts}


def exactly(name: str, words: list[str], *fields: str) -> dict:
    if len(words) != len(fields):
        raise EngineError(f"{name} needs {' and '.join(fields) or 'nothing more'}")
    return dict(zip(fields, words, strict=True))


def parse(line: str) -> Command:
    """A command; names in any case, words between spaces, on a single line."""
    if "\0" in line or "\n" in line.rstrip("\r\n") or "\r" in line.rstrip("\r\n"):
        raise EngineError("a command is a single line")
    words = line.split()
    if not words:
        raise EngineError("no command")
    name, rest = words[0].upper(), words[1:]
    if name == "SIM":
        return Command(name, parse_sim(rest))
    if name == "SIMV":
        return Command(name, parse_simv(rest))
    if name == "EVENT":
        return Command(name, parse_event(rest))
    if name == "VECSET":
        if len(rest) < 2:
            raise EngineError("VECSET needs an id and a vector")
        return Command(name, {"id": rest[0], "vector": [number(w) for w in rest[1:]]})
    if name == "VECDEL":
        return Command(name, exactly(name, rest, "id"))
    if name == "METASET":
        return Command(name, exactly(name, rest, "id", "pairs"))
    if name == "INFO":
        return Command(name, exactly(name, rest))
    if name in ("DUMP", "CACHE", "DEBUG", "CONFIG") and rest:
        return Command(f"{name} {rest[0].upper()}", {"rest": rest[1:]})
    if name == "SET" and len(rest) == 3 and rest[1] == "=":
        return Command("SET", {"name": rest[0], "value": rest[2]})
    if name == "GET":
        return Command("GET", exactly(name, rest, "name"))
    if name == "SHOW" and rest and rest[0].upper() == "VARIABLES":
        like = rest[1:]
        if like and (like[0].upper() != "LIKE" or len(like) != 2):
            raise EngineError("SHOW VARIABLES takes LIKE and a pattern")
        return Command("SHOW VARIABLES", {"prefix": like[1].strip("'\"").partition("%")[0] if like else ""})
    raise EngineError(f"unknown command: {name}")
