"""Module types of the pipeline language: their options, inputs and outputs, as functions on DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text
from ..operators import corpus as ops
from ..operators import embeddings as emb
from ..operators import decompose, dynamic_topics, fasttext, features, glove, models, scaling, stats, vocab
from ..scratch import write_table
from ..sources import fasttext_bin, readers, sinks


def to_bool(x: str) -> bool:
    if x.strip().lower() in ("t", "true", "1", "yes", "y"):
        return True
    if x.strip().lower() in ("f", "false", "0", "no", "n", ""):
        return False
    raise ValueError(f"no truth value: {x}")


def to_int(x: str) -> int:
    """An integer, also with k or m for thousands or millions."""
    factor = {"k": 1000, "m": 1_000_000}.get(x.strip().lower()[-1:], 1)
    return int(float(x.strip()[:-1]) * factor) if factor > 1 else int(x)


def to_list(x: str) -> list[str]:
    return [y.strip() for y in x.split(",") if y.strip()]


def choice(*of: str) -> Callable[[str], str]:
    def pick(x: str) -> str:
        if x not in of:
            raise ValueError(f"{x} is none of {', '.join(of)}")
        return x

    return pick


@dataclass(frozen=True)
class ModuleType:
    """run(spark, inputs, options) -> outputs by name, the first being the default. inputs: name -> frames; a name
    ending in * takes any number. kinds: the document type that each input needs."""

    run: Callable[[SparkSession, dict[str, list[DataFrame]], dict], dict[str, DataFrame]]
    inputs: tuple[str, ...] = ("corpus",)
    outputs: tuple[str, ...] = ("corpus",)
    options: dict[str, Callable[[str], object]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    needs: dict[str, str] = field(default_factory=dict)  # input -> payload column that it must have


TYPES: dict[str, ModuleType] = {}


def _add(name: str, run, **kw) -> None:
    TYPES[name] = ModuleType(run, **kw)


def _map(name: str, function, column: str, out: str, **options) -> None:
    """A map of one payload column into another (or the same), invalid documents left as they are."""

    def run(spark, inputs, o):
        c = inputs["corpus"][0]
        value = F.when(F.col("error").isNull(), function(F.col(column), **o))
        done = c.withColumn(out, value)
        return {"corpus": done if out == column else done.drop(column)}

    _add(name, run, options=options, needs={"corpus": column})


_map("text.simple_tokenize", lambda c, splitter=" ": text.simple_tokenize(c, splitter), "text", "sentences", splitter=str)
_map("text.char_tokenize", text.char_tokenize, "text", "sentences")
_map("text.text_normalize", lambda c, case=None, strip=False, blank_lines=False: text.text_normalize(c, case=case, strip_lines=strip, drop_blank=blank_lines), "text", "text", case=choice("upper", "lower", ""), strip=to_bool, blank_lines=to_bool)
_map("text.normalize", text.token_normalize, "sentences", "sentences", case=choice("upper", "lower", ""), remove_empty=to_bool, remove_only_punct=to_bool, remove_punct=to_bool, remove_nums=to_bool, min_word_length=to_int, strict_compat=to_bool)
_map("nltk.nist_tokenize", lambda c, lowercase=False, non_european=False: text.nist_tokenize(c, lowercase), "text", "sentences", lowercase=to_bool, non_european=lambda x: false_only(x))


def false_only(x: str) -> bool:
    """For options that only their default is supported of."""
    if to_bool(x):
        raise ValueError("not supported")
    return False


def _format(spark, inputs, o):
    c = inputs["corpus"][0]
    column = model.payload_columns(c)[0]
    kind = o.get("formatter") or {"sentences": "tokenized", "vector": "vector", "lists": "integer_lists"}.get(column, "text")
    return {"formatted": c.select(*model.KEYS, text.format_document(kind, F.col(column)).alias("text"), "error")}


_add("corpora.format", _format, outputs=("formatted",), options={"formatter": str})
_add("corpora.store", lambda s, i, o: {"corpus": i["corpus"][0]})
_add("corpora.concat", lambda s, i, o: {"corpus": ops.concat(i["corpora"])}, inputs=("corpora*",))
_add("corpora.interleave", lambda s, i, o: {"corpus": ops.group(ops.interleave(i["corpora"]).drop("pos"), o.get("archive_size", 1000), o.get("archive_basename", "archive"))}, inputs=("corpora*",), options={"archive_size": to_int, "archive_basename": str})
_add("corpora.group", lambda s, i, o: {"corpus": ops.group(i["corpus"][0], o.get("archive_size", 1000), o.get("archive_basename", "archive"))}, options={"archive_size": to_int, "archive_basename": str})
_add("corpora.subset", lambda s, i, o: {"corpus": ops.subset(i["corpus"][0], o["size"], o.get("offset", 0), skip_invalid=o.get("skip_invalid", False))}, options={"size": to_int, "offset": to_int, "skip_invalid": to_bool}, required=("size",))
_add("corpora.subsample", lambda s, i, o: {"corpus": ops.subsample(i["corpus"][0], o["p"], o.get("seed", 1234), skip_invalid=o.get("skip_invalid", False))}, options={"p": float, "seed": to_int, "skip_invalid": to_bool}, required=("p",))


def _split(spark, inputs, o):
    a, b = ops.split(inputs["corpus"][0], o.get("set1_size", 0.2), o.get("seed", 1234))
    return {"set1": a, "set2": b, "doc_list1": ops.names(a), "doc_list2": ops.names(b)}


_add("corpora.split", _split, outputs=("set1", "set2", "doc_list1", "doc_list2"), options={"set1_size": float, "seed": to_int})


def _list_filter(spark, inputs, o):
    a, b = ops.list_filter(inputs["corpus"][0], inputs["list"][0])
    return {"set1": a, "set2": b}


_add("corpora.list_filter", _list_filter, inputs=("corpus", "list"), outputs=("set1", "set2"))


def _shuffle(spark, inputs, o):
    mixed = ops.shuffle(inputs["corpus"][0], o.get("seed", 999), keep_archive_names=o.get("keep_archive_names", False)).drop("pos")
    return {"corpus": ops.group(mixed, o.get("archive_size", 1000), o.get("archive_basename", "archive"))}


def _shuffle_linear(spark, inputs, o):
    mixed = ops.shuffle_linear(inputs["corpus"][0], o.get("seed", 999), bin_size=o.get("bin_size", 100), num_bins=o.get("num_bins", 0), keep_archive_names=o.get("keep_archive_names", False)).drop("pos")
    return {"corpus": ops.group(mixed, o.get("archive_size", 1000), o.get("archive_basename", "archive"))}


_SHUFFLE = {"seed": to_int, "keep_archive_names": to_bool, "archive_size": to_int, "archive_basename": str}
_add("corpora.shuffle", _shuffle, options=_SHUFFLE)
_add("corpora.shuffle_linear", _shuffle_linear, options=_SHUFFLE | {"bin_size": to_int, "num_bins": to_int})
_add("corpora.corpus_stats", lambda s, i, o: {"stats": stats.corpus_stats(i["corpus"][0])}, outputs=("stats",), needs={"corpus": "sentences"})


def _vocab_builder(spark, inputs, o):
    stop = inputs["stopwords"][0].select(F.col("value").alias("token")) if inputs.get("stopwords") else None
    v = vocab.build(inputs["text"][0], threshold=o.get("threshold", 0), max_prop=o.get("max_prop", 1.0), limit=o.get("limit"), include=o.get("include"), oov=o.get("oov"), stopwords=stop)
    return {"vocab": v.words, "stopwords": v.stopwords.select(F.col("token").alias("value"))}


_add("corpora.vocab_builder", _vocab_builder, inputs=("text", "stopwords?"), outputs=("vocab", "stopwords"), options={"threshold": to_int, "max_prop": float, "limit": to_int, "include": to_list, "oov": str, "prune_at": to_int}, needs={"text": "sentences"})
_add("corpora.vocab_mapper", lambda s, i, o: {"ids": vocab.map_tokens(i["text"][0], i["vocab"][0], o.get("oov"))}, inputs=("text", "vocab"), outputs=("ids",), options={"oov": str, "row_length_bytes": to_int}, needs={"text": "sentences"})
_add("corpora.vocab_unmapper", lambda s, i, o: {"tokenized": vocab.unmap_ids(i["ids"][0], i["vocab"][0], o.get("oov"))}, inputs=("ids", "vocab"), outputs=("tokenized",), options={"oov": str}, needs={"ids": "lists"})
_add("corpora.vocab_counter", lambda s, i, o: {"distribution": vocab.count(i["corpus"][0], i["vocab"][0], oov_excluded=o.get("oov_excluded", False))}, inputs=("corpus", "vocab"), outputs=("distribution",), options={"oov_excluded": to_bool}, needs={"corpus": "lists"})


def _reader(name: str, function, **options) -> None:
    _add(name, function, inputs=(), options=options, required=("files",))


_reader("input.text.raw_text_files", lambda s, i, o: {"corpus": readers.text_files(s, o["files"], exclude=o.get("exclude"), encoding=o.get("encoding", "utf8"), encoding_errors=o.get("encoding_errors", "strict"))}, files=to_list, exclude=to_list, encoding=str, encoding_errors=str)
_reader("input.text.raw_text_archives", lambda s, i, o: {"corpus": readers.text_archives(s, o["files"], encoding=o.get("encoding", "utf8"), encoding_errors=o.get("encoding_errors", "strict"))}, files=to_list, encoding=str, encoding_errors=str)
_reader("input.text.europarl", lambda s, i, o: {"corpus": readers.europarl(readers.text_files(s, o["files"], exclude=o.get("exclude"), encoding=o.get("encoding", "utf8"), encoding_errors=o.get("encoding_errors", "strict")))}, files=to_list, exclude=to_list, encoding=str, encoding_errors=str)
_reader("input.xml", lambda s, i, o: {"corpus": readers.xml_files(s, o["files"], exclude=o.get("exclude"), encoding=o.get("encoding", "utf8"), encoding_errors=o.get("encoding_errors", "strict"), node=o.get("document_node_type", "doc"), name_attr=o.get("document_name_attr", "filename"), attrs=dict(x.split("=", 1) for x in o.get("filter_on_doc_attr", [])))}, files=to_list, exclude=to_list, encoding=str, encoding_errors=str, document_node_type=str, document_name_attr=str, filter_on_doc_attr=to_list)
_reader("input.document_archives", lambda s, i, o: {"corpus": readers.document_archives(s, o["files"], o.get("payload", "text"))}, files=to_list, payload=str)
_add("input.table", lambda s, i, o: {"corpus": model.from_table(s.read.parquet(o["path"]), order=o["order"], payload={"text": F.col(o.get("text", "text"))}, archive=o.get("archive"), name=o.get("name"))}, inputs=(), options={"path": str, "order": str, "text": str, "archive": str, "name": str}, required=("path", "order"))
_add("input.stored", lambda s, i, o: {"corpus": readers.load(s, o["dir"])}, inputs=(), options={"dir": str}, required=("dir",))
_add("input.embeddings.word2vec", lambda s, i, o: {"embeddings": readers.word2vec(s, o["path"], binary=o.get("binary", True), limit=o.get("limit"))}, inputs=(), outputs=("embeddings",), options={"path": str, "binary": to_bool, "limit": to_int}, required=("path",))
_add("input.embeddings.glove", lambda s, i, o: {"embeddings": readers.glove_text(s, o["path"])}, inputs=(), outputs=("embeddings",), options={"path": str}, required=("path",))
_add("input.embeddings.fasttext_vec", lambda s, i, o: {"embeddings": readers.fasttext_vec(s, o["path"], o.get("limit"))}, inputs=(), outputs=("embeddings",), options={"path": str, "limit": to_int}, required=("path",))


def _sink(function):
    def run(spark, inputs, o):
        frame = next(iter(inputs.values()))[0]
        function(frame, o)
        return {"done": frame.limit(0)}

    return run


_add("output.text_corpus", _sink(lambda c, o: sinks.text_corpus(c, o["path"], archive_dirs=o.get("archive_dirs", False), suffix=o.get("suffix"), invalid=o.get("invalid", "skip"), tar=o.get("tar", False))), outputs=("done",), options={"path": str, "archive_dirs": to_bool, "suffix": str, "invalid": choice("skip", "empty"), "tar": to_bool}, required=("path",), needs={"corpus": "text"})
_add("embeddings.store_tsv", _sink(lambda e, o: sinks.store_tsv(e, o["path"])), inputs=("embeddings",), outputs=("done",), options={"path": str}, required=("path",))
_add("embeddings.store_word2vec", _sink(lambda e, o: sinks.store_word2vec(e, o["path"])), inputs=("embeddings",), outputs=("done",), options={"path": str}, required=("path",))
_add("embeddings.store_embeddings", lambda s, i, o: {"embeddings": i["embeddings"][0]}, inputs=("embeddings",), outputs=("embeddings",))
_add("embeddings.normalize", lambda s, i, o: {"embeddings": emb.l2_normalize(i["embeddings"][0]) if o.get("l2_norm", True) else i["embeddings"][0]}, inputs=("embeddings",), outputs=("embeddings",), options={"l2_norm": to_bool})
_add("embeddings.word2vec", lambda s, i, o: {"model": models.train_word2vec(i["text"][0], size=o.get("size", 200), min_count=o.get("min_count", 5), iterations=o.get("iters", 5))}, inputs=("text",), outputs=("model",), options={"size": to_int, "min_count": to_int, "iters": to_int, "negative_samples": to_int}, needs={"text": "sentences"})


def _glove(spark, inputs, o):
    corpus = inputs["text"][0]
    counts = vocab.word_counts(corpus).where(F.col("n") >= o.get("min_count", 0))
    words = vocab.number_words(counts, o.get("max_vocab") or None)
    known = vocab.map_tokens(corpus, words.select("id", "token"), "skip").select(F.flatten("lists").alias("tokens"))
    n, once = words.count(), o.get("symmetric", True)
    pairs = features.cooccurrence(known, o.get("window_size", 15), symmetric=once, distance_weighting=o.get("distance_weighting", True), n_words=n, once=once)
    given = {"size": o.get("vector_size", 50), "iterations": o.get("iter", 25)} | {k: o[k] for k in ("eta", "alpha", "x_max", "grad_clip", "seed") if k in o}
    found, _ = glove.train(pairs, n, mirrored=once, **given)
    rows = found.join(words, found["idx"] == words["id"])
    both = rows.select("idx", F.col("token").alias("word"), F.col("n").alias("count"), F.zip_with("vector", "context", lambda x, y: x + y).alias("vector"))
    return {"embeddings": both, "glove_output": rows.select("idx", F.col("token").alias("word"), "vector", "context")}


_GLOVE = {"max_vocab": to_int, "min_count": to_int, "symmetric": to_bool, "window_size": to_int, "distance_weighting": to_bool, "vector_size": to_int, "iter": to_int, "seed": to_int, "eta": float, "alpha": float, "x_max": float, "grad_clip": float}
_add("embeddings.glove", _glove, inputs=("text",), outputs=("embeddings", "glove_output"), options=_GLOVE, needs={"text": "sentences"})
_add("embeddings.mapper", lambda s, i, o: {"vectors": emb.doc_vectors(i["corpus"][0], i["embeddings"][0])}, inputs=("corpus", "embeddings"), outputs=("vectors",), needs={"corpus": "sentences"})


_FASTTEXT = {"model": choice("skipgram", "cbow"), "dim": to_int, "lr": float, "ws": to_int, "epoch": to_int, "min_count": to_int, "minn": to_int, "maxn": to_int, "neg": to_int, "bucket": to_int, "t": float, "loss": choice("ns"), "word_ngrams": to_int}


def _fasttext(spark, inputs, o):
    """Vectors of the vocabulary; the whole model goes to the file that path names."""
    found, _ = fasttext.train(inputs["text"][0], **{k: v for k, v in o.items() if k in _FASTTEXT})
    if "path" in o:
        fasttext_bin.write(found, o["path"])
    return {"embeddings": fasttext.word_vectors(found)}


_add("embeddings.fasttext", _fasttext, inputs=("text",), outputs=("embeddings",), options=_FASTTEXT | {"path": str}, needs={"text": "sentences"})
_add("embeddings.mappers.fasttext", lambda s, i, o: {"vectors": fasttext.doc_vectors(i["corpus"][0], fasttext_bin.load(s, o["path"]))}, outputs=("vectors",), options={"path": str}, required=("path",), needs={"corpus": "sentences"})
_add("input.embeddings.fasttext", lambda s, i, o: {"embeddings": fasttext_bin.read_vectors(s, o["path"], o.get("limit"))}, inputs=(), outputs=("embeddings",), options={"path": str, "limit": to_int}, required=("path",))


def _lda(spark, inputs, o):
    words, lda = models.train_lda(inputs["corpus"][0], num_topics=o.get("num_topics", 100), iterations=o.get("iterations", 50))
    return {"top_words": models.lda_top_words(words, lda, o.get("num_words", 15)), "doc_topics": models.lda_doc_topics(inputs["corpus"][0], words, lda)}


_add("gensim.lda", _lda, outputs=("top_words", "doc_topics"), options={"num_topics": to_int, "iterations": to_int, "num_words": to_int}, needs={"corpus": "sentences"})


def _ids_of(words: DataFrame, terms: list[str]) -> list[int]:
    """Ids of terms that the vocabulary must have."""
    found = {r.token: r.id for r in words.where(F.col("token").isin(terms)).collect()} if terms else {}  # one row a term
    if missing := [t for t in terms if t not in found]:
        raise ValueError(f"not in the vocabulary: {', '.join(missing)}")
    return list(found.values())


_DTM = {"alphas": float, "num_topics": to_int, "chain_variance": float, "passes": to_int, "lda_inference_max_iter": to_int, "em_min_iter": to_int, "em_max_iter": to_int, "tfidf": to_bool}


def _ldaseq(spark, inputs, o):
    words = inputs["vocab"][0]
    given = {k: v for k, v in o.items() if k in _DTM}
    found = dynamic_topics.train(inputs["corpus"][0], inputs["labels"][0], words.count(), ignore_ids=_ids_of(words, o.get("ignore_terms", [])), **given)
    return {"model": dynamic_topics.to_table(spark, found), "top_words": dynamic_topics.top_words(spark, found, words, o.get("num_words", 15))}


def _ldaseq_doc_topics(spark, inputs, o):
    c = inputs["corpus"][0]
    found = dynamic_topics.doc_topics(c, inputs["labels"][0], dynamic_topics.from_table(inputs["model"][0]))
    known = c.join(found.select("doc_ord", F.col("topics").alias("vector")), "doc_ord", "left")
    lost = F.when(F.col("error").isNull() & F.col("vector").isNull(), model.error("ldaseq_doc_topics", "no time slice of the model")).otherwise(F.col("error"))
    return {"vectors": known.select(*model.KEYS, "vector", lost.alias("error"))}


_add("gensim.ldaseq", _ldaseq, inputs=("corpus", "labels", "vocab"), outputs=("model", "top_words"), options=_DTM | {"ignore_terms": to_list, "num_words": to_int}, needs={"corpus": "lists", "labels": "label"})
_add("gensim.ldaseq_doc_topics", _ldaseq_doc_topics, inputs=("corpus", "labels", "model"), outputs=("vectors",), needs={"corpus": "lists", "labels": "label"})
_add("gensim.coherence", lambda s, i, o: {"coherence": features.coherence(i["corpus"][0], i["topics"][0], o.get("coherence", "u_mass"), window=o.get("window_size"))}, inputs=("corpus", "topics"), outputs=("coherence",), options={"coherence": choice("u_mass", "c_v", "c_uci", "c_npmi"), "window_size": to_int}, needs={"corpus": "sentences"})
_add("regex.annotated_text", lambda s, i, o: {"matches": features.match_annotations(i["documents"][0], o["expr"])}, inputs=("documents",), outputs=("matches",), options={"expr": str}, required=("expr",), needs={"documents": "sentences"})
_add("visualization.bar_chart", lambda s, i, o: {"data": sinks.chart_data([(r["label"], r["value"]) for x in i["values"] for r in x.select("label", "value").collect()], s)}, inputs=("values*",), outputs=("data",), options={"labels": to_list, "colors": to_list})


def _embeddings_plot(spark, inputs, o):
    """label, x, y, colour of each set's most frequent words, all sets in one plane."""
    if "colors" in o and len(o["colors"]) < len(inputs["vectors"]):
        raise ValueError("a colour for each set is needed")
    sets = [e.select(F.lit(i).alias("source"), "idx", "word", "count", F.col("vector").cast("array<double>").alias("vector")) for i, e in enumerate(inputs["vectors"])]
    rows = emb.most_frequent(reduce(DataFrame.unionByName, sets), o.get("words", 50), o.get("skip", 0))
    rows = rows.withColumn("id", F.col("source").cast("long") * F.lit(1 << 40) + F.col("rank"))
    place = scaling.tsne if o.get("reduction", "mds") == "tsne" else scaling.mds
    found = rows.join(place(rows, metric=o.get("metric", "cosine"), id_col="id"), "id")
    label, colour = F.col("word"), F.lit("b")
    if "cmap" in o:
        for prefix, name in reversed(o["cmap"].items()):
            mine = F.startswith(F.col("word"), F.lit(prefix))
            label, colour = F.when(mine, F.substr("word", F.lit(len(prefix) + 1))).otherwise(label), F.when(mine, F.lit(name)).otherwise(colour)
    elif "colors" in o:
        colour = F.element_at(F.array(*[F.lit(c) for c in o["colors"]]), F.col("source") + 1)
    return {"data": found.select(label.alias("label"), F.get("point", 0).alias("x"), F.get("point", 1).alias("y"), colour.alias("colour"))}


_add("visualization.embeddings_plot", _embeddings_plot, inputs=("vectors*",), outputs=("data",), options={"words": to_int, "skip": to_int, "metric": choice("cosine", "euclidean", "manhattan"), "reduction": choice("mds", "tsne"), "cmap": json.loads, "colors": to_list})


def _settings(x: str) -> dict:
    """name=value pairs, or a JSON dictionary with or without its braces."""
    x = x.strip()
    if "=" in x and ":" not in x:
        return {k.strip(): json.loads(v) for k, v in (y.split("=", 1) for y in to_list(x))}
    return json.loads(x if x.startswith("{") else f"{{{x}}}")


def _factorise(spark, inputs, o):
    """w: id, features of the rows; h: id, features of the columns."""
    settings = dict(o.get("options", {}))
    k, kind, cells = settings.pop("n_components", 50), o["class"], inputs["matrix"][0]
    renamed = {"max_iter": "max_iter", "tol": "tol", "random_state": "seed"}
    known = {"TruncatedSVD": {"random_state"}, "FastICA": set(renamed), "FactorAnalysis": {"max_iter", "tol"}, "PCA": set(), "NMF": {"max_iter", "random_state"}}[kind]
    if unknown := set(settings) - known:
        raise ValueError(f"{kind} has no options {', '.join(sorted(unknown))}")
    given = {renamed[k]: v for k, v in settings.items()}
    if kind == "TruncatedSVD":
        found = decompose.svd(cells, k, **given)
        scaled = F.zip_with("features", F.array(*[F.lit(float(v)) for v in found.values]), lambda a, b: a * b)
        return {"w": found.left.select("id", scaled.alias("features")), "h": found.right}
    if kind == "NMF":
        w, h = models.factorise(cells, size=k, iterations=given.get("max_iter", 10), seed=given.get("seed", 1), nonnegative=True)
        return {"w": w, "h": h}
    # the others need rows in full, so the columns are bounded
    width = (cells.agg(F.max("feature_id")).first()[0] or 0) + 1
    if width > decompose.MOST_COLUMNS:
        raise ValueError(f"{kind} takes {decompose.MOST_COLUMNS} columns at most")
    as_map = cells.dropna().groupBy("term_id", "feature_id").agg(F.sum("n").alias("n")).groupBy("term_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "n"))).alias("m"))
    rows = write_table(as_map.select(F.col("term_id").alias("idx"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double")).alias("vector")), "factor-rows")
    if kind == "PCA":
        found = decompose.principal(rows, k)
    else:
        found = (decompose.fast_ica if kind == "FastICA" else decompose.factor_analysis)(rows, k, **given)
    return {"w": found.sources, "h": spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(found.mixing)], "id bigint, features array<double>")}


_add("sklearn.matrix_factorization", _factorise, inputs=("matrix",), outputs=("w", "h"), options={"class": choice("TruncatedSVD", "FastICA", "FactorAnalysis", "PCA", "NMF"), "options": _settings}, required=("class",))


def multistage(name: str, stages: list[tuple[str, str, dict[str, str]]]) -> None:
    """Registers a type that runs stages (stage name, type, options) one after the other on its first input; further
    options are stage_option."""

    def run(spark, inputs, o):
        now = inputs
        out: dict[str, DataFrame] = {}
        for stage, kind, fixed in stages:
            t = TYPES[kind]
            given = {k: t.options[k](v) for k, v in fixed.items()} | {k.removeprefix(f"{stage}_"): v for k, v in o.items() if k.startswith(f"{stage}_")}
            out = t.run(spark, now if len(t.inputs) > 1 else {t.inputs[0].rstrip("*?"): next(iter(now.values()))}, given)
            now = {"corpus": [next(iter(out.values()))]}
        return out

    options = {f"{stage}_{k}": f for stage, kind, _ in stages for k, f in TYPES[kind].options.items()}
    _add(name, run, inputs=TYPES[stages[0][1]].inputs, outputs=TYPES[stages[-1][1]].outputs, options=options)
