"""External annotators as maps: the library is loaded once a task; without it the map fails at once.

Each function returns a MapPlan for mapping.map_documents(). Models are named, or paths that all executors see.
"""

from __future__ import annotations

from collections.abc import Callable

from .mapping import MapPlan, StopProcessing

_TOKENS = "sentences array<array<string>>"


def _spacy(model: str) -> Callable[[], object]:
    def load():
        try:
            import spacy
        except ImportError as e:
            raise StopProcessing("spacy is not installed on the executors") from e
        return spacy.load(model)

    return load


def spacy_tokenizer(model: str = "en_core_web_sm") -> MapPlan:
    """Text to sentences of tokens."""
    return MapPlan("spacy_tokenizer", _TOKENS, lambda nlp, doc: {"sentences": [[t.text for t in s] for s in nlp(doc["text"]).sents]}, set_up=_spacy(model))


def spacy_parser(model: str = "en_core_web_sm") -> MapPlan:
    """Text to sentences of (word, pos, head, deprel); head counts from the sentence's first word."""

    def parse(nlp, doc):
        return {"sentences": [[{"word": t.text, "pos": t.pos_, "head": str(t.head.i - s.start), "deprel": t.dep_} for t in s] for s in nlp(doc["text"]).sents]}

    return MapPlan("spacy_text_parser", "sentences array<array<struct<word:string,pos:string,head:string,deprel:string>>>", parse, set_up=_spacy(model))


def spacy_noun_phrases(model: str = "en_core_web_sm") -> MapPlan:
    """Text to its noun phrases, one a line."""
    return MapPlan("spacy_extract_nps", "text string", lambda nlp, doc: {"text": "\n".join(c.text for c in nlp(doc["text"]).noun_chunks)}, set_up=_spacy(model))


def external(name: str, output: str, start: Callable[[], object], process: Callable[[object, dict], dict], stop: Callable[[object], None] = lambda tool: None, batch: Callable[[object, list[dict]], list[dict]] | None = None) -> MapPlan:
    """Any other tool (a parser's server, a gateway to another runtime): start() gives a handle in each task, process
    or batch uses it, stop ends it."""
    return MapPlan(name, output, process, batch, start, stop)
