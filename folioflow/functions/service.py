"""Addresses, model names and prompts of outside services, as columns and plain text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LANGUAGES

#: Default addresses and models by protocol.
DEFAULT_BASE = {"gemini": "https://generativelanguage.googleapis.com", "openai": "https://api.openai.com/v1"}
DEFAULT_MODEL = {"gemini": "gemini-2.5-flash", "openai": "gpt-4o-mini"}
#: A path segment that states a version, at the end of an address.
_VERSION = r"/v[0-9]+[a-zA-Z]*[0-9]*"


def base_url(url: Column) -> Column:
    """An address without query, fragment and closing slashes, with a protocol; empty stays empty."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?#].*$", ""), "/+$", "")
    return F.when(bare == "", "").when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), F.regexp_replace(bare, "^/+", "")))


def model_name(model: Column, protocol: Column) -> Column:
    """The last segment of what may be a path or a whole address, without ``models/``; a default where there is none."""
    m = F.regexp_replace(F.trim(F.coalesce(model, F.lit(""))), "^/+", "")
    last = F.regexp_extract(F.regexp_replace(m, r"\?.*$", ""), r"([^/]+)/*$", 1)
    named = F.regexp_replace(F.when(m.rlike("(?i)^https?://") & (last != ""), last).otherwise(m), "(?i)^models/", "")
    return F.when(m == "", F.when(protocol == "gemini", DEFAULT_MODEL["gemini"]).otherwise(DEFAULT_MODEL["openai"])).otherwise(named)


def service_endpoint(url: Column, kind: Column, protocol: Column) -> Column:
    """Where requests (``kind`` chat) or the list of models (``models``) of a protocol go; ``{model}`` stands for the model.

    What an address already has of the path, or more of it, is taken off first.
    """
    given = base_url(url)
    base = F.when(given != "", given).when(protocol == "gemini", DEFAULT_BASE["gemini"]).otherwise(DEFAULT_BASE["openai"])
    root = F.regexp_replace(F.regexp_replace(base, r"/models(?:[/:].*)?$", ""), r"(?i)(?::(?:stream)?generateContent|/[^/:]+:.*)$", "")
    root = F.regexp_replace(root, f"(?i)(?:{_VERSION})+$", "")
    gemini = F.concat(root, F.when(kind == "models", "/v1beta/models").otherwise("/v1beta/models/{model}:generateContent"))
    service = F.regexp_replace(base, r"(?i)(?:/chat/completions)+$", "")
    stated = F.regexp_replace(service, "(?i)^https?://[^/]+", "").rlike(f"(?i){_VERSION}(?:/|$)")
    bare = F.regexp_replace(service, r"(?i)(?:/models)+$", "")
    listed = F.concat(bare, F.when(stated, "").otherwise("/v1"), F.lit("/models"))
    plain = F.regexp_replace(base, r"(?i)(?:/models)+$", "")
    chat = F.concat(plain, F.when(plain.rlike(f"(?i){_VERSION}$"), "").otherwise("/v1"), F.lit("/chat/completions"))
    chat = F.when(base.rlike("(?i)/chat/completions$"), base).otherwise(chat)
    return F.when(protocol == "gemini", gemini).when(kind == "models", listed).otherwise(chat)


def resolved(endpoint: Column, model: Column, protocol: Column, key: Column) -> Column:
    """An endpoint with its model, and for one protocol with its key in the query."""
    u = F.replace(endpoint, F.lit("{model}"), F.replace(F.url_encode(model), F.lit("+"), F.lit("%20")))
    mark = F.when(F.contains(u, F.lit("?")), "&").otherwise("?")
    return F.when((protocol == "gemini") & (F.coalesce(key, F.lit("")) != ""), F.concat(u, mark, F.lit("key="), F.url_encode(key))).otherwise(u)


# Prompts --------------------------------------------------------------------------------------------------------------

_BOXES = "Give each box as [x0, y0, x1, y1], whole numbers from 0 to 1000 of the picture's width and height, origin at the upper left."
_RULES = "Read each line on its own, in reading order. Do not invent text. Keep numbers, units, codes and names as they are."


def _extras(hint: str, glossary: tuple[list[str], list[str]]) -> list[str]:
    maps, keeps = glossary
    parts = [f"Background: {hint}"] if hint else []
    parts += ["Use these terms:\n" + "\n".join(maps)] if maps else []
    return parts + (["Leave these as they are:\n" + "\n".join(keeps)] if keeps else [])


def glossary_lines(entries: list[tuple[str, str, bool]]) -> tuple[list[str], list[str]]:
    """Terms to map and terms to keep, in order, as lines of a prompt."""
    return [f"{t} => {to}" for t, to, keep in entries if t and to and not keep], [t for t, _, keep in entries if t and keep]


def reading_prompt(lang: str = "zh-CN", translate: bool = True, region: bool = True, label: str = "", hint: str = "", entries: list[tuple[str, str, bool]] = ()) -> str:
    """What a vision model is asked: to read a cropped region or a whole page, and to translate unless that is another's task."""
    target = LANGUAGES.get(lang, LANGUAGES["zh-CN"])
    what = "a part cut out of a page; lines may be cut off" if region else "a whole page; look at small marks, corners and captions too"
    item = '{"text":"...","translation":"...","box":[x0,y0,x1,y1]}' if translate else '{"text":"...","box":[x0,y0,x1,y1]}'
    parts = [f"The picture is {what}." + (f" Its number is {label}." if label else ""), "Find all readable English text." + (f" Translate each line into {target}." if translate else "")]
    parts += [_BOXES, f'Answer with JSON alone: {{"items":[{item}]}}. Without text: {{"items":[]}}.', _RULES]
    parts += [f"Translate faithfully and briefly, in the usage of the trade in {target}."] if translate else []
    return "\n\n".join(parts + _extras(hint, glossary_lines(entries if translate else [])))


def translation_prompt(lang: str = "zh-CN", hint: str = "", entries: list[tuple[str, str, bool]] = ()) -> str:
    """The standing instruction for translating lines of text."""
    target = LANGUAGES.get(lang, LANGUAGES["zh-CN"])
    parts = [f"Translate English document lines into {target}. Mend evident reading errors first.", _RULES, "Answer with the translation alone."]
    return "\n\n".join(parts + _extras(hint, glossary_lines(entries)))


def batch_prompt(texts: list[str], lang: str = "zh-CN") -> str:
    """One request for several lines, answered by number."""
    target = LANGUAGES.get(lang, LANGUAGES["zh-CN"])
    return f'Translate these into {target}. Answer with a JSON array of {{"id": number, "translation": "..."}} alone.\n\n' + json.dumps([{"id": i, "text": t} for i, t in enumerate(texts)], ensure_ascii=False)
