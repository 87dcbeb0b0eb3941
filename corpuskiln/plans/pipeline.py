"""Pipelines: modules of a pipeline file as lazily built DataFrames, with stored outputs and their status."""

from __future__ import annotations

import argparse
import hashlib
import json
import re
import shutil
import sys
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import config
from .modules import TYPES, ModuleType


class Pipeline:
    """A loaded pipeline. output() builds a module's DataFrame; run() stores outputs, and stored ones are read back."""

    def __init__(self, name: str, modules: list[config.Module], aliases: dict[str, str], variants: set[str], store: str):
        self.name, self.aliases, self.variants, self.store = name, aliases, variants, store.rstrip("/")
        self.modules = {m.name: m for m in modules}
        self._built: dict[str, dict[str, DataFrame]] = {}
        self.check()

    @classmethod
    def load(cls, path: str | Path, variant: str = "main", store: str | None = None, local: dict[str, str] | None = None) -> Pipeline:
        sections, variants = config.read(path, variant, local)
        if variant not in variants:
            raise config.PipelineError(f"no variant {variant} in {path}")
        modules, aliases = config.expand(sections, {k for k, t in TYPES.items() if not t.inputs})
        name = sections["pipeline"]["name"]
        return cls(name, modules, aliases, variants, store or str(Path(path).parent / "output" / name / variant))

    def check(self) -> None:
        """Types, options and inputs of all modules. Modules only take inputs from before them, so there are no cycles."""
        for m in self.modules.values():
            kind = TYPES.get(m.type)
            if kind is None:
                raise config.PipelineError(f"[{m.name}] has the unknown type {m.type}")
            for k in m.options:
                if k not in kind.options:
                    raise config.PipelineError(f"[{m.name}] has no option {k}; there are {', '.join(kind.options) or 'none'}")
            for k in kind.required:
                if k not in m.options:
                    raise config.PipelineError(f"[{m.name}] needs the option {k}")
            self._options(m, kind)
            given = self._named_inputs(m, kind)
            for spec in kind.inputs:
                name = spec.rstrip("*?")
                if not spec.endswith("?") and name not in given:
                    raise config.PipelineError(f"[{m.name}] needs the input {name}")
                if not spec.endswith("*") and len(given.get(name, [])) > 1:
                    raise config.PipelineError(f"[{m.name}] takes one {name}")
            for name, sources in given.items():
                for source, out in sources:
                    outputs = TYPES[self.modules[source].type].outputs
                    if out is not None and out not in outputs:
                        raise config.PipelineError(f"[{m.name}]: {source} has no output {out}; there are {', '.join(outputs)}")

    def _options(self, m: config.Module, kind: ModuleType) -> dict:
        out = {}
        for k, v in m.options.items():
            try:
                out[k] = kind.options[k](v)
            except (ValueError, KeyError) as e:
                raise config.PipelineError(f"[{m.name}] {k}={v}: {e}") from e
        return out

    @staticmethod
    def _named_inputs(m: config.Module, kind: ModuleType) -> dict[str, list]:
        names = [x.rstrip("*?") for x in kind.inputs]
        out = {}
        for k, v in m.inputs.items():
            if k and k not in names:
                raise config.PipelineError(f"[{m.name}] has no input {k}; there are {', '.join(names) or 'none'}")
            out[k or (names[0] if names else "")] = v
        return out

    def _name(self, ref: str) -> tuple[str, str | None]:
        return config._resolve(ref, self.modules, self.aliases)

    # --- building ---

    def output(self, spark: SparkSession, ref: str) -> DataFrame:
        """The DataFrame of module or module.output."""
        name, out = self._name(ref)
        outputs = self.outputs(spark, name)
        return outputs[out] if out else next(iter(outputs.values()))

    def outputs(self, spark: SparkSession, name: str) -> dict[str, DataFrame]:
        if name not in self._built:
            m = self.modules[name]
            kind = TYPES[m.type]
            if self.status(name) == "COMPLETE":
                self._built[name] = {o: spark.read.parquet(self._path(name, o)) for o in json.loads(self._mark(name).read_text())["outputs"]}
            else:
                inputs = {k: [self.output(spark, f"{s}.{o}" if o else s) for s, o in v] for k, v in self._named_inputs(m, kind).items()}
                for k, column in kind.needs.items():
                    for frame in inputs.get(k, []):
                        if column not in frame.columns:
                            raise config.PipelineError(f"[{name}] needs {column} in its input {k}, which has {', '.join(frame.columns)}")
                self._built[name] = kind.run(spark, inputs, self._options(m, kind))
        return self._built[name]

    # --- storing ---

    def _path(self, name: str, output: str) -> str:
        return f"{self.store}/{self._folder(name)}/{output}"

    @staticmethod
    def _folder(name: str) -> str:
        """A module's name as a folder: brackets and the like would be read as patterns."""
        plain = re.sub(r"[^\w.-]", "_", name)
        return plain if plain == name else f"{plain}-{hashlib.md5(name.encode()).hexdigest()[:6]}"

    def _mark(self, name: str) -> Path:
        return Path(self.store, self._folder(name), "_DONE")

    def run(self, spark: SparkSession, names: list[str] | None = None) -> list[str]:
        """Stores the outputs of the named modules (default: all) and of what they need, in order; complete ones and
        filters are not stored again. Returns the names of the modules that ran."""
        wanted = [self._name(n)[0] for n in names] if names else list(self.modules)
        needed: set[str] = set()

        def need(name: str) -> None:
            if name not in needed:
                needed.add(name)
                for sources in self.modules[name].inputs.values():
                    for s, _ in sources:
                        need(s)

        for n in wanted:
            need(n)
        ran = []
        for name, m in self.modules.items():
            if name not in needed or self.status(name) == "COMPLETE" or (m.filter and name not in wanted):
                continue
            outputs = self.outputs(spark, name)
            for o, frame in outputs.items():
                frame.write.mode("overwrite").parquet(self._path(name, o))
            self._mark(name).parent.mkdir(parents=True, exist_ok=True)
            self._mark(name).write_text(json.dumps({"outputs": list(outputs), "type": m.type, "options": m.options}))
            self._built = {k: v for k, v in self._built.items() if k != name}
            ran.append(name)
        return ran

    def status(self, name: str) -> str:
        """COMPLETE (stored), FILTER (built when read), READY or WAITING (an input is not stored yet)."""
        if self._mark(name).exists():
            return "COMPLETE"
        m = self.modules[name]
        if m.filter:
            return "FILTER"
        sources = {s for v in m.inputs.values() for s, _ in v}
        return "READY" if all(self.status(s) in ("COMPLETE", "FILTER") for s in sources) else "WAITING"

    def reset(self, name: str) -> list[str]:
        """Forgets stored outputs of a module and of all that depend on it."""
        gone = [name]
        for n, m in self.modules.items():
            if any(s in gone for v in m.inputs.values() for s, _ in v):
                gone.append(n)
        for n in gone:
            shutil.rmtree(Path(self.store, self._folder(n)), ignore_errors=True)
            self._built.pop(n, None)
        return gone


    def dump(self, name: str, archive: str) -> None:
        """A stored module's outputs as a tar file, to take to another place."""
        if self.status(name) != "COMPLETE":
            raise config.PipelineError(f"{name} is not stored")
        with tarfile.open(archive, "w:gz") as out:
            out.add(Path(self.store, self._folder(name)), self._folder(name))

    def load_dump(self, name: str, archive: str) -> None:
        """Puts dumped outputs of a module in place of its stored ones."""
        self.reset(name)
        with tarfile.open(archive) as given:
            folder = self._folder(name)
            if any(m.name.split("/")[0] != folder for m in given):
                raise config.PipelineError(f"{archive} holds no dump of {name}")
            given.extractall(self.store, filter="data")


def main(argv: list[str] | None = None) -> int:
    """Command line: FILE [--variant V] status | run [MODULE ...] | reset MODULE | variants | explain OUTPUT |
    show OUTPUT | dump MODULE TAR | load MODULE TAR"""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("file")
    p.add_argument("--variant", default="main")
    p.add_argument("--store")
    p.add_argument("command", choices=["status", "run", "reset", "variants", "explain", "show", "dump", "load"])
    p.add_argument("names", nargs="*")
    a = p.parse_args(argv)
    pipeline = Pipeline.load(a.file, a.variant, a.store)
    if a.command == "variants":
        print(*sorted(pipeline.variants), sep="\n")
    elif a.command == "status":
        for n in pipeline.modules:
            print(f"{n}: {pipeline.status(n)}")
    elif a.command == "dump":
        pipeline.dump(*a.names)
    elif a.command == "load":
        pipeline.load_dump(*a.names)
    elif a.command == "reset":
        for n in a.names:
            print(*pipeline.reset(n), sep="\n")
    else:
        spark = SparkSession.builder.getOrCreate()
        if a.command == "run":
            print(*pipeline.run(spark, a.names or None), sep="\n")
        for n in a.names if a.command != "run" else ():
            frame = pipeline.output(spark, n)
            frame.explain("formatted") if a.command == "explain" else frame.show(20, truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main())
