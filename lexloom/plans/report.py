"""The whole analysis: independent stages over the same documents, joined by doc_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.functions.text import rounded, share
from lexloom.lexicon import RUSSIAN, LexicalProfile
from lexloom.operators import ai, copying, grammar, language, latent, metrics, ngrams, semantic, spam, style, tampering
from lexloom.plans import stages
from lexloom.sources import providers
from lexloom.storage import batches_of, stored
from lexloom.streaming import jobs

RESULT = ["doc_id", "plagiarism_pct", "paraphrase_pct", "self_plagiarism_pct", "cited_pct", "originality_pct", "spam_pct", "junk_words_pct",
          "grammar_errors", "readability_score", "ai_probability", "ai_verdict"]
#: Rows of a batch that goes to Python, where several steps of a task hold one each; texts may be long.
AT_ONCE = 1000


def originality(plagiarism, paraphrase, own):
    """100 less all three, within 0 and 100; overlaps are taken off twice by design."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), rounded(F.lit(100.0) - plagiarism - paraphrase - own, 1)))


def signals(docs: DataFrame, profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig()) -> DataFrame:
    """doc_id and all signals of a row alone: texts are read and cut once, nothing is shuffled."""
    tokens = metrics.tokenized(docs).withColumns(style.columns(profile, config) | spam.columns(profile) | {"top": spam.top_sum(profile, config), "grammar_errors": grammar.local_count(F.col("text"))})
    return ai.with_probability(tokens, profile, config).drop("text", "words", "sentences", "sentence_words")


def originality_report(docs: DataFrame, corpus: DataFrame, profile: LexicalProfile = RUSSIAN, config: EngineConfig = EngineConfig(),
                       paraphrase: DataFrame | None = None, author: str = "source", checker=None) -> DataFrame:
    """RESULT for every document. paraphrase: doc_id, paraphrase_pct; 0 without it. checker: a grammar
    checker in place of the local rules."""
    ids = spam.repeated(docs)
    with batches_of(docs.sparkSession, AT_ONCE):  # each part is a job of its own; what is joined in the end is small and waits for nothing
        out = stored(signals(docs, profile, config), "report-signals")
        cut = stored(copying.hashed(docs, config, author), "report-hashes")
        copied = stored(copying.copy_pct(cut, corpus, config).select("doc_id", "plagiarism_pct"), "report-copied")
        own = stored(copying.self_copy_pct(cut, config, author, ids is None).select("doc_id", "self_plagiarism_pct"), "report-own")
        if paraphrase is not None:
            paraphrase = stored(paraphrase.select("doc_id", "paraphrase_pct"), "report-paraphrase")
        if ids is not None:  # rows that share an id are one document
            top = stored(spam.top_words(metrics.tokenized(docs), profile, config, ids).groupBy("doc_id").agg(F.sum("cnt").alias("top")), "report-top")
            out = out.drop("top").join(top, "doc_id", "left")
    if checker is not None:
        out = out.drop("grammar_errors").join(grammar.grammar(docs, checker).select("doc_id", "grammar_errors"), "doc_id", "left")
    out = out.withColumns({
        "spam_pct": share(F.coalesce("top", F.lit(0)), F.col("total_words")), "junk_words_pct": share(F.col("junk_words"), F.col("total_words"))})
    out = out.join(copied, "doc_id", "left").join(own, "doc_id", "left")
    if paraphrase is None:
        out = out.withColumn("paraphrase_pct", F.lit(0.0))
    else:
        out = out.join(paraphrase, "doc_id", "left").withColumn("paraphrase_pct", F.coalesce("paraphrase_pct", F.lit(0.0)))
    return out.withColumn("originality_pct", originality(F.col("plagiarism_pct"), F.col("paraphrase_pct"), F.col("self_plagiarism_pct"))).select(*RESULT)


@dataclass(frozen=True)
class AnalysisFrames:
    """A frame for each table of results; all are keyed by doc_id."""

    documents: DataFrame
    results: DataFrame
    copy_sources: DataFrame
    self_copy_sources: DataFrame
    top_words: DataFrame
    ai_features: DataFrame
    rare_shingles: DataFrame
    tampering_flags: DataFrame
    details: DataFrame


class Engine:
    """analyze(documents, corpus): documents have doc_id, text and an author column; corpus doc_id,
    text and, if known, title. provider: a search provider; checker: a grammar checker; embedder: a
    Column builder of sentence vectors, by default learned from documents and corpus; scorers: of AI
    features; languages: profiles as `language.learn` gives them, without which scripts alone tell
    languages; perplexity: whether a model of the corpus adds that feature."""

    def __init__(self, config: EngineConfig = EngineConfig(), profile: LexicalProfile = RUSSIAN, embedder=None, author: str = "source", provider=None, checker=None, scorers=None,
                 languages: DataFrame | None = None, perplexity: bool = False):
        self.config, self.profile, self.embedder, self.author = config, profile, embedder, author
        self.provider, self.checker, self.scorers = provider, checker, scorers
        self.languages, self.perplexity = languages, perplexity

    def sentences(self, docs: DataFrame, corpus: DataFrame) -> DataFrame:
        """doc_id, similarity and nearest_group (the source) of each sentence, by nearest corpus sentence."""
        # of the documents only the sentences are stored, which are far smaller than their vectors; `nearest` embeds each once
        ours, theirs = (stored(semantic.sentences(d).withColumn("vec_id", F.monotonically_increasing_id()), "sentences") for d in (docs, corpus))
        embed = self.embedder or self.learned_of(ours.select("sentence").unionByName(theirs.select("sentence")))
        theirs = stored(theirs.withColumn("embedding", embed(F.col("sentence"))), "sentence-vectors")
        best = semantic.nearest(ours.withColumn("embedding", embed(F.col("sentence"))), theirs)
        found = ours.select("doc_id", "vec_id").join(best, "vec_id", "left")
        return found.join(theirs.select(F.col("vec_id").alias("nearest_id"), F.col("doc_id").alias("nearest_group")), "nearest_id", "left")

    @staticmethod
    def learned(docs: DataFrame, corpus: DataFrame):
        """An embedder learned from the sentences of both."""
        both = semantic.sentences(docs.select("doc_id", "text")).unionByName(semantic.sentences(corpus.select("doc_id", "text")))
        return Engine.learned_of(both.select("sentence"))

    @staticmethod
    def learned_of(sentences: DataFrame):
        """An embedder learned from sentences that are cut already."""
        return latent.embedder(latent.learn(sentences), sentences.sparkSession)

    def paraphrase(self, docs: DataFrame, corpus: DataFrame) -> DataFrame:
        """doc_id, total_sentences, matched_sentences, paraphrase_pct."""
        return semantic.paraphrase_pct(self.sentences(docs, corpus), "doc_id", self.config)

    def scored(self, docs: DataFrame, corpus: DataFrame) -> DataFrame:
        """AI features and probability; see ai.ai_probability."""
        tokens = metrics.tokenized(docs)
        if self.perplexity:
            tokens = ai.with_perplexity(tokens, docs, ngrams.train(corpus))
        return ai.ai_probability(tokens, self.profile, self.config, self.scorers)

    def external_search(self, docs: DataFrame, corpus: DataFrame) -> DataFrame:
        sample = copying.rare_shingles(docs, corpus, self.config).select("doc_id", "phrase")
        return providers.external_search(sample, self.provider, self.config, docs)

    def analyze(self, docs: DataFrame, corpus: DataFrame, with_paraphrase: bool = False) -> AnalysisFrames:
        c, tokens = self.config, metrics.tokenized(docs)
        flags = tampering.homoglyphs(docs).select("doc_id", F.lit("HOMOGLYPH").alias("type"), "position", F.concat_ws(" ", "char", "looks_like", "word").alias("details")).unionByName(
            tampering.zero_width(docs).select("doc_id", F.lit("ZERO_WIDTH").alias("type"), "position", F.col("label").alias("details")))
        para = self.paraphrase(docs, corpus) if with_paraphrase else None
        results = originality_report(docs, corpus, self.profile, c, para, self.author, self.checker)
        described = metrics.basic_metrics(docs, c).join(language.dominant(docs, c, language.trigram_detector(self.languages)), "doc_id", "left")
        return AnalysisFrames(described, results, self.titled(copying.copy_sources(docs, corpus, c), corpus), copying.self_copy_sources(docs, c, self.author), spam.top_words(tokens, self.profile, c),
                              self.scored(docs, corpus), copying.rare_shingles(docs, corpus, c), flags, self.details(docs, corpus, with_paraphrase))

    @staticmethod
    def titled(sources: DataFrame, corpus: DataFrame) -> DataFrame:
        if "title" not in corpus.columns:
            return sources.withColumn("title", F.lit(None).cast("string"))
        return sources.join(corpus.select(F.col("doc_id").alias("corpus_doc_id"), "title"), "corpus_doc_id", "left")

    def sections(self, docs: DataFrame, corpus: DataFrame, with_paraphrase: bool = True, own_sources: bool = True, together: bool = False) -> dict[str, DataFrame]:
        """doc_id, section of each stage, in their order; lists in a fixed order. own_sources: whether the
        author's other documents are listed, which grows with the square of those that share a passage.
        together: whether all sections are wanted, so that hashes, signals and errors are worked out and
        stored first, once for all of them."""
        c, tokens, cut, unique, errors = self.config, metrics.tokenized(docs), docs, False, self.checker or grammar.local_errors
        if together:
            unique = spam.repeated(docs) is None
            with batches_of(docs.sparkSession, AT_ONCE):
                cut = stored(copying.hashed(docs, c, self.author), "section-hashes")
                if self.checker is None:
                    local = stored(grammar.local_errors(docs), "section-errors")
                    errors = lambda _: local

        def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
            return df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

        def section(df: DataFrame, *columns) -> DataFrame:
            return df.select("doc_id", F.struct(*columns).alias("section"))

        with batches_of(docs.sparkSession, AT_ONCE):
            pct, sources = copying.copied(cut, corpus, c)
        copied = pct.join(listed(self.titled(sources, corpus), "sources", "corpus_doc_id", "title", "matched_shingles"), "doc_id", "left")
        own = copying.self_copy_pct(cut, c, self.author, unique).select("doc_id", "enabled", F.col("total_shingles").alias("own_total"), F.col("matched_shingles").alias("own_matched"))
        own = stored(own, "section-own") if together else own
        if own_sources:
            own = own.join(listed(copying.self_copy_sources(cut, c, self.author), "own_sources", "other_doc_id", "matched_shingles"), "doc_id", "left")
        else:
            own = own.withColumn("own_sources", F.lit(None).cast(f"array<struct<other_doc_id: {docs.schema['doc_id'].dataType.simpleString()}, matched_shingles: bigint>>"))
        found = {"plagiarism": section(
            copied.join(own, "doc_id", "left"), F.lit(c.shingle_size).alias("shingle_size"), "total_shingles", "matched_shingles", "sources",
            F.struct("enabled", F.col("own_total").alias("total_shingles"), F.col("own_matched").alias("matched_shingles"), F.col("own_sources").alias("sources")).alias("self_plagiarism"))}
        if with_paraphrase:
            each = self.sentences(docs, corpus)
            para = semantic.paraphrase_pct(each, "doc_id", c).join(listed(semantic.paraphrase_sources(each, "doc_id", c), "sources", "nearest_group", "matched_sentences"), "doc_id", "left")
            found["paraphrase"] = section(docs.select("doc_id").join(para, "doc_id", "left"), F.coalesce("total_sentences", F.lit(0)).alias("total_sentences"), F.coalesce("matched_sentences", F.lit(0)).alias("matched_sentences"), "sources")
        checked = grammar.grammar(docs, errors)
        found["grammar"] = section(checked, F.col("grammar_errors").alias("total_errors"), F.col("grammar_by_category").alias("by_category"), "errors")
        if "error" in checked.columns:
            parts = found["grammar"].join(checked.select("doc_id", "error"), "doc_id", "left")
            found["grammar"] = parts.withColumn("section", F.when(F.col("error").isNull(), F.col("section")))
        styled, top, scored = (self.row_sections if together else self.each_section)(docs, corpus, tokens, unique)
        found["style"] = section(styled, "long_sentences_pct", "passive_voice_pct", "bureaucracy_pct", "word_repetitions", "matched_cliches")
        if top is None:
            top = docs.select("doc_id").join(listed(spam.top_words(tokens, self.profile, c), "top_words", "rank", "word", "cnt"), "doc_id", "left")
        found["spam"] = section(top, "top_words")
        found["aiDetector"] = section(scored, F.struct(*(n for n in scored.columns if n not in ("doc_id", "ai_probability", "ai_verdict"))).alias("features"), F.col("ai_probability").alias("probability"), F.col("ai_verdict").alias("verdict"))
        found["externalSearch"] = section(self.external_search(docs, corpus), "enabled", "provider", "queried_phrases", "results")
        return found

    def each_section(self, docs: DataFrame, corpus: DataFrame, tokens: DataFrame, unique: bool) -> tuple[DataFrame, None, DataFrame]:
        """style, most used words (left to the caller) and AI features, each from the texts."""
        return style.style(tokens, self.profile, self.config), None, self.scored(docs, corpus)

    def row_sections(self, docs: DataFrame, corpus: DataFrame, tokens: DataFrame, unique: bool) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        """The same, stored by one job that cuts each text once; most used words too, if no rows share an id."""
        c, cut = self.config, [n for n in tokens.columns if n != "doc_id"]
        if self.perplexity:
            tokens = ai.with_perplexity(tokens, docs, ngrams.train(corpus))
        rows = tokens.withColumn("_style", F.struct(*(x.alias(n) for n, x in style.columns(self.profile, c).items())))
        if unique:
            used = F.transform(spam.most_used(F.col("words"), self.profile, c), lambda w, i: F.struct((i + 1).cast("long").alias("rank"), w["word"].alias("word"), w["cnt"].alias("cnt")))
            rows = rows.withColumn("_top", used)
        with batches_of(docs.sparkSession, AT_ONCE):
            rows = stored(ai.with_probability(rows, self.profile, c, self.scorers).drop(*cut), "section-signals")
        top = rows.select("doc_id", F.when(F.size("_top") > 0, F.col("_top")).alias("top_words")) if unique else None
        return rows.select("doc_id", "_style.*"), top, rows.drop("_style", "_top")

    def details(self, docs: DataFrame, corpus: DataFrame, with_paraphrase: bool = True, own_sources: bool = True) -> DataFrame:
        """doc_id, details: a struct with a section for each stage; see sections."""
        found = self.sections(docs, corpus, with_paraphrase, own_sources, together=True)
        return stages.merged(docs, found).select("doc_id", F.struct(*found).alias("details"))

    def run(self, docs: DataFrame, corpus: DataFrame, folder: str, retries: int = 0) -> DataFrame:
        """Every stage as a job of its own over `docs`, its sections stored in `folder`; see stages.run."""
        each = {name: (lambda left, name=name: self.sections(left, corpus, name == "paraphrase")[name]) for name in jobs.STAGES}
        return stages.run(docs, each, folder, retries, self.config)


def response(described: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, response: a document's counts and, if it has one, its result, as JSON."""
    scalars = [c for c in RESULT if c != "doc_id"]
    result = F.when(F.col("plagiarism_pct").isNotNull(), F.struct(*scalars))
    own = [c for c in described.columns if c != "doc_id"]
    return described.join(results.select(*RESULT), "doc_id", "left").select("doc_id", F.to_json(F.struct("doc_id", *own, result.alias("result")), {"ignoreNullFields": "false"}).alias("response"))


def details_response(details: DataFrame, flags: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """doc_id, response: a document's details, tampering flags and file metadata, as JSON."""
    listed = flags.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "type", "details"))).alias("tampering_flags"))
    out = details.join(listed, "doc_id", "left")
    if metadata is None:
        out = out.withColumn("metadata", F.lit(None).cast("string"))
    else:
        out = out.join(metadata.select("doc_id", F.struct(*(c for c in metadata.columns if c != "doc_id")).alias("metadata")), "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct("doc_id", "details", F.coalesce("tampering_flags", F.array().cast(listed.schema["tampering_flags"].dataType)).alias("tampering_flags"), "metadata"), {"ignoreNullFields": "false"}).alias("response"))
