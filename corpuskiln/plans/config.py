"""The pipeline language: sections of key=value lines with directives, variables, alternatives and module variables.

read() turns a file into sections, expand() turns sections into modules: each alternative of a parameter, and each
alternative of a module's inputs, gives a module of its own.
"""

from __future__ import annotations

import itertools
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

SPECIAL_SECTIONS = ("pipeline", "vars")
#: Options that steer expansion and are no options of a module.
STEERING = ("type", "tie_alts", "alt_naming", "filter")


class PipelineError(Exception):
    """A pipeline file that can't be read or built."""


@dataclass
class Module:
    """One node: its options are final; inputs are (input name, [(module, output or None)])."""

    name: str
    type: str
    options: dict[str, str]
    inputs: dict[str, list[tuple[str, str | None]]]
    filter: bool = False
    base: str = ""  # the section it comes from
    alt: str | None = None  # its alternative's name
    modvars: dict[str, object] = field(default_factory=dict)


# --- reading ---


def read(path: str | Path, variant: str = "main", local: dict[str, str] | None = None) -> tuple[dict[str, dict[str, str]], set[str]]:
    """Sections of a pipeline file in order, with variables put in, and the variants that it names."""
    path = Path(path)
    lines, variants, abstract = _directives(path, variant)
    if abstract:
        raise PipelineError(f"{path} is abstract: it can only be included")
    sections, copies = _sections(lines)
    constants = {"project_root": str(path.parent), "output_dir": str(path.parent / "output"), "home": os.path.expanduser("~"), "test_data_dir": str(path.parent / "data"), **(local or {})}
    for k, v in sections.pop("vars", {}).items():
        constants[k] = _substitute(v, constants)
    out: dict[str, dict[str, str]] = {}
    for name, options in sections.items():
        whole: dict[str, str] = {}
        for source, but in copies.get(name, []):
            if source not in sections or source not in out:
                raise PipelineError(f"[{name}] copies [{source}], which doesn't come before it")
            whole |= {k: v for k, v in out[source].items() if k not in but}
        out[name] = whole | {k: _substitute(v, constants) for k, v in options.items()}
    if "pipeline" not in out or "name" not in out["pipeline"]:
        raise PipelineError(f"{path} needs a [pipeline] section with a name")
    return out, variants


def _directives(path: Path, variant: str) -> tuple[list[str], set[str], bool]:
    """Lines with includes put in and variants chosen."""
    out: list[str] = []
    variants: set[str] = {"main"}
    abstract = False
    for line in path.read_text(encoding="utf8").splitlines():
        text = line.strip()
        if not text.startswith("%%"):
            out.append(line)
            continue
        body = text[2:].strip()
        chosen = re.match(r"(?:variant:(?P<a>\S+)|\((?P<b>[^)]*)\))\s*(?P<rest>.*)$", body)
        if chosen:
            names = set((chosen["a"] or chosen["b"]).split(","))
            variants |= names
            if variant in names:
                out.append(chosen["rest"])
        elif body.startswith("novariant"):
            if variant == "main":
                out.append(body.removeprefix("novariant").strip())
        elif body.startswith("include"):
            more, names, _ = _directives(path.parent / body.removeprefix("include").strip(), variant)
            out += more
            variants |= names
        elif body.startswith("abstract"):
            abstract = True
        elif body.startswith("copy"):
            out.append(f"%%{body}")
        else:
            raise PipelineError(f"unknown directive: {text}")
    return out, variants, abstract


def _sections(lines: list[str]) -> tuple[dict[str, dict[str, str]], dict[str, list[tuple[str, set[str]]]]]:
    sections: dict[str, dict[str, str]] = {}
    copies: dict[str, list[tuple[str, set[str]]]] = {}
    at = key = None
    for line in lines:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        if text.startswith("[") and text.endswith("]"):
            at, key = text[1:-1].strip(), None
            if at in sections:
                raise PipelineError(f"section [{at}] occurs twice")
            sections[at] = {}
        elif at is None:
            raise PipelineError(f"line before the first section: {text}")
        elif text.startswith("%%copy"):
            source, *but = text.split()[1:]
            copies.setdefault(at, []).append((source, set(but)))
        elif line[0].isspace() and key is not None:
            sections[at][key] += "\n" + text
        elif "=" in text:
            key, _, value = (x.strip() for x in text.partition("="))
            sections[at][key] = value
        else:
            raise PipelineError(f"no key=value line: {text}")
    return sections, copies


def _substitute(value: str, constants: dict[str, str]) -> str:
    def put(m: re.Match) -> str:
        if m[1] not in constants:
            raise PipelineError(f"unknown variable {m[1]} in {value!r}")
        return constants[m[1]]

    return re.sub(r"%\(([^)]+)\)s", put, value)


# --- expansion ---


def alternatives(value: str) -> list[tuple[str | None, str]]:
    """(name or None, value) of each alternative; a bar inside parentheses or after a backslash doesn't separate."""
    parts, depth, now = [], 0, ""
    for i, c in enumerate(value):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0 and value[i - 1 : i] != "\\":
            parts.append(now)
            now = ""
        else:
            now += c
    parts.append(now)
    out = []
    for p in parts:
        m = re.match(r"\{([^}]*)\}(.*)$", p.strip(), re.S)
        out.append((m[1], m[2].strip()) if m else (None, p.strip().replace("\\|", "|")))
    return out


def split_inputs(value: str) -> list[str]:
    """Comma-separated inputs; name*N stands N times."""
    out = []
    for part in (x.strip() for x in value.split(",")):
        m = re.match(r"(?P<name>[^*].*?)\*(?P<n>\d+)$", part)
        out += [m["name"]] * int(m["n"]) if m else [part]
    return [x for x in out if x]


def expand(sections: dict[str, dict[str, str]], no_input: set[str]) -> tuple[list[Module], dict[str, str]]:
    """Modules in order and aliases. no_input: types that read from outside, which don't default to the module before."""
    modules: dict[str, Module] = {}
    groups: dict[str, list[str]] = {}  # names of a section's modules
    aliases: dict[str, str] = {}
    last: str | None = None
    for section, raw in sections.items():
        if section in SPECIAL_SECTIONS:
            continue
        kind = raw.get("type")
        if not kind:
            raise PipelineError(f"[{section}] has no type")
        if kind == "alias":
            aliases[section] = raw.get("input", "")
            groups[section] = [aliases[section]]
            continue
        options = {k: v for k, v in raw.items() if k not in STEERING}
        if last is not None and kind not in no_input and not any(k == "input" or k.startswith("input_") for k in options):
            options["input"] = last
        made = _expand_section(section, kind, raw, options, modules, groups, aliases)
        groups[section] = [m.name for m in made]
        modules |= {m.name: m for m in made}
        last = section
    return list(modules.values()), aliases


def _expand_section(section: str, kind: str, raw: dict, options: dict, modules: dict, groups: dict, aliases: dict) -> list[Module]:
    choices: dict[str, list[tuple[str | None, str]]] = {}
    for key, value in options.items():
        if key == "input" or key.startswith("input_"):
            found = alternatives(value)
            if len(found) == 1:
                found = _input_alternatives(found[0][1], groups, aliases)
            choices[key] = found
        elif not key.startswith("modvar_"):
            choices[key] = alternatives(value)
    many = [k for k, v in choices.items() if len(v) > 1]
    ties = _ties(raw.get("tie_alts", ""), many, choices)
    out = []
    for picks in itertools.product(*[range(max(len(choices[k]) for k in tie)) for tie in ties]):
        chosen = {k: choices[k][i] for tie, i in zip(ties, picks, strict=True) for k in tie}
        final = {k: chosen.get(k, v[0])[1] for k, v in choices.items()}
        alt = _alt_name(raw.get("alt_naming", ""), many, chosen) if many else None
        inputs = {}
        for k in [k for k in final if k == "input" or k.startswith("input_")]:
            value = final.pop(k)
            inputs[k.removeprefix("input").removeprefix("_")] = [_resolve(x, modules, aliases) for y in split_inputs(value) for x in _all_of(y, groups)]
        module = Module(f"{section}[{alt}]" if alt else section, kind, final, inputs, raw.get("filter", "F").upper() in ("T", "TRUE", "1", "YES"), section, alt)
        module.modvars = _inherited(module, modules)
        for k, v in options.items():
            if k.startswith("modvar_"):
                module.modvars[k.removeprefix("modvar_")] = evaluate(v, module, modules)
        module.options = {k: _put_modvars(v, module, modules) for k, v in final.items()}
        out.append(module)
    return out


def _input_alternatives(value: str, groups: dict, aliases: dict) -> list[tuple[str | None, str]]:
    """A single input that names a section with alternatives takes each of them in turn."""
    name, dot, output = value.partition(".") if "[" not in value else (value, "", "")
    name = aliases.get(name, name)
    found = groups.get(name, [])
    if value.startswith("*") or "," in value or len(found) < 2:
        return [(None, value)]
    return [(m[m.index("[") + 1 : -1] if "[" in m else None, f"{m}{dot}{output}") for m in found]


def _all_of(value: str, groups: dict) -> list[str]:
    """*name: all alternatives of a section, side by side."""
    if not value.startswith("*"):
        return [value]
    name, dot, output = value[1:].partition(".")
    if name not in groups:
        raise PipelineError(f"no module {name}")
    return [f"{m}{dot}{output}" for m in groups[name]]


def _resolve(value: str, modules: dict, aliases: dict) -> tuple[str, str | None]:
    m = re.match(r"(?P<name>[^\[.]+(?:\[.*\])?)(?:\.(?P<out>\w+))?$", value)
    if not m:
        raise PipelineError(f"can't read the input {value!r}")
    name, out = m["name"], m["out"]
    while name in aliases:
        name, _, given = aliases[name].partition(".")
        out = out or given or None
    if name not in modules:
        raise PipelineError(f"no module {name}")
    return name, out


def _ties(given: str, many: list[str], choices: dict) -> list[list[str]]:
    if given.upper() in ("T", "TRUE", "1", "YES"):
        groups = [many] if many else []
    else:
        groups = [[k for k in g.split("|") if k in many] for g in given.split()]
        groups = [g for g in groups if g]
        groups += [[k] for k in many if not any(k in g for g in groups)]
    for g in groups:
        if len({len(choices[k]) for k in g}) > 1:
            raise PipelineError(f"tied parameters {g} have different numbers of alternatives")
    return groups


def _alt_name(naming: str, many: list[str], chosen: dict) -> str:
    label = lambda k: chosen[k][0] if chosen[k][0] is not None else chosen[k][1]
    only = re.match(r"option\(([^)]*)\)$", naming)
    if only:
        return "~".join(label(k.strip()) for k in only[1].split(","))
    if naming == "pos" or (len(many) == 1 and not naming.startswith("full")):
        return "~".join(dict.fromkeys(label(k) for k in many))
    short = "inputnames" in naming
    return "~".join(f"{k.removeprefix('input_') if short else k}={label(k)}" for k in many)


# --- module variables ---


def _inherited(module: Module, modules: dict) -> dict[str, object]:
    out: dict[str, object] = {}
    for sources in module.inputs.values():
        merged: dict[str, list] = {}
        for name, _ in sources:
            for k, v in modules[name].modvars.items():
                merged.setdefault(k, []).append(v)
        for k, v in merged.items():
            out.setdefault(k, v[0] if len(sources) == 1 else v)
    return out


_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<int>-?\d+)|(?P<name>[A-Za-z_][\w.]*)|(?P<op>->|[()\[\],*|]))')


def evaluate(expr: str, module: Module, modules: dict) -> object:
    """A module variable's value: a string or number, a variable, input.variable, x[i], altname([input]),
    map(x, a -> b | * -> c), join(sep, x), len(x). Plain text that is no expression is a string."""
    tokens, at = [], 0
    while at < len(expr.rstrip()):
        m = _TOKEN.match(expr, at)
        if not m:
            return expr
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    try:
        parser = _Parser(tokens, module, modules)
        value = parser.term()
        return value if parser.at == len(tokens) else expr
    except (IndexError, KeyError):
        return expr


class _Parser:
    def __init__(self, tokens: list, module: Module, modules: dict):
        self.tokens, self.at, self.module, self.modules = tokens, 0, module, modules

    def next(self, expected: str | None = None) -> tuple[str, str]:
        kind, text = self.tokens[self.at]
        if expected is not None and text != expected:
            raise PipelineError(f"expected {expected} but found {text}")
        self.at += 1
        return kind, text

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def term(self) -> object:
        kind, text = self.next()
        if kind == "str":
            value: object = re.sub(r"\\(.)", r"\1", text[1:-1])
        elif kind == "int":
            value = int(text)
        elif self.peek() == "(" and text in ("altname", "map", "join", "len"):
            value = getattr(self, f"_{text}")()
        else:
            value = self._variable(text)
        while self.peek() == "[":
            self.next("[")
            i = int(self.next()[1])
            self.next("]")
            value = value[i]
        return value

    def _variable(self, name: str) -> object:
        if "." in name:
            source, _, var = name.partition(".")
            found = [self.modules[m].modvars[var] for m, _ in self.module.inputs[source]]
            return found[0] if len(found) == 1 else found
        return self.module.modvars[name]

    def _altname(self) -> object:
        self.next("(")
        if self.peek() == ")":
            self.next()
            return self.module.alt or ""
        found = [self.modules[m].alt or "" for m, _ in self.module.inputs[self.next()[1]]]
        self.next(")")
        return found[0] if len(found) == 1 else found

    def _len(self) -> int:
        self.next("(")
        value = self.term()
        self.next(")")
        return len(value)

    def _join(self) -> str:
        self.next("(")
        between = str(self.term())
        self.next(",")
        value = self.term()
        self.next(")")
        return between.join(map(str, value if isinstance(value, list) else [value]))

    def _map(self) -> object:
        self.next("(")
        value = self.term()
        table: dict[object, object] = {}
        rest: object = None
        while self.peek() in (",", "|"):
            self.next()
            star = self.peek() == "*"
            key = self.next()[1] if star else self._literal()
            self.next("->")
            if star:
                rest = self._literal()
            else:
                table[str(key)] = self._literal()
        self.next(")")
        one = lambda v: table.get(str(v), rest if rest is not None else v)
        return [one(v) for v in value] if isinstance(value, list) else one(value)

    def _literal(self) -> object:
        kind, text = self.next()
        return text[1:-1] if kind == "str" else int(text) if kind == "int" else text


def _put_modvars(value: str, module: Module, modules: dict) -> str:
    def put(m: re.Match) -> str:
        got = evaluate(m[1], module, modules)
        return ",".join(map(str, got)) if isinstance(got, list) else str(got)

    return re.sub(r"\$\(((?:[^()]|\([^()]*\))*)\)", put, value)
