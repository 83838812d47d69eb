"""Sections of documents: lookups, context, outlines, neighbours, summaries, examples, health, what a deletion would break.

Sections are tables (id, doc, parent_id, level, title, content, byte_start,
byte_end); a null parent_id is a top section. Trees are walked level by level,
to at most DEPTH levels, so no row ever holds more than its own ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.graph import bfs, cut

DEPTH = 20


def breadcrumbs(sections: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, depth, path: titles from the top section down, and how deep a section is; a row a section, by pointer jumping towards the root."""
    up = cut(sections.select("id", F.col("parent_id").alias("above"), F.array("title").alias("path")))
    done, reach = 0, 1
    while reach < 2 * depth:
        above = up.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("path").alias("more"))
        up = cut(up.join(above, "above", "left").select("id", F.col("next").alias("above"), F.concat(F.coalesce("more", F.array().cast("array<string>")), "path").alias("path")))
        done, reach = done + 1, 2 * reach
        if up.where("above is not null").isEmpty():
            break
    return up.select("id", (F.size("path") - 1).alias("depth"), "path")


def outline(sections: DataFrame) -> DataFrame:
    """doc, place, id, depth, title: sections of each document in the order of their bytes."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("byte_start", "id"))
    return sections.join(breadcrumbs(sections).select("id", "depth"), "id").select("doc", place.alias("place"), "id", "depth", "title")


def toc_tree(sections: DataFrame) -> DataFrame:
    """id, path, children, place: the way to a section, how many it has below it, and its place among its parent's."""
    kids = sections.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    place = F.row_number().over(Window.partitionBy("doc", "parent_id").orderBy("byte_start", "id"))
    named = sections.select("id", place.alias("place")).join(kids, "id", "left").join(breadcrumbs(sections), "id")
    return named.select("id", F.array_join("path", " > ").alias("path"), F.coalesce("children", F.lit(0)).cast("long").alias("children"), "place")


def describe(sections: DataFrame) -> DataFrame:
    """id, breadcrumb, children, prev_id, next_id, bytes."""
    w = Window.partitionBy("doc").orderBy("byte_start", "id")
    near = sections.select("id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"), (F.col("byte_end") - F.col("byte_start")).alias("bytes"))
    return toc_tree(sections).select("id", F.col("path").alias("breadcrumb"), "children").join(near, "id")


def get(sections: DataFrame, wanted: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """id, content and, with hashes (id, content_hash), whether the content still has it: of the wanted ids (id) that there are."""
    found = sections.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "content")
    if hashes is None:
        return found
    return found.join(hashes, "id", "left").select("id", "content", F.sha2(F.col("content").cast("binary"), 256).eqNullSafe(F.col("content_hash")).alias("ok"))


def file_slice(files: DataFrame, first: int, last: int) -> DataFrame:
    """path, content of (path, content): lines first to last, counted from 1."""
    return files.select("path", F.array_join(F.slice(F.split("content", "\n"), first, max(0, last - first + 1)), "\n").alias("content"))


def byte_slice(content: Column, start: Column, length: Column) -> Column:
    """The text of a byte range; a range that cuts a character gives a replacement mark there."""
    return F.decode(F.substring(content.cast("binary"), start + 1, length), "UTF-8")


def context(sections: DataFrame, wanted: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """id, other, part, tokens: for each wanted section its ancestors, itself and its children that fit its budget together, nearest the root first.

    A section costs a token for every four bytes, one at least; what doesn't
    fit is skipped and later ones may still fit. A list holds one section's
    ancestors and children only.
    """
    own = sections.join(wanted.select("id").distinct(), "id", "left_semi").select("id", F.col("parent_id").alias("above"))
    cost = sections.select(F.col("id").alias("other"), F.greatest(F.lit(1), F.floor(F.octet_length("content") / 4)).cast("int").alias("tokens"), "byte_start", F.col("parent_id").alias("of"))
    rows = own.select("id", F.col("id").alias("other"), F.lit(0).alias("step"))
    step, now = 0, own
    while step < DEPTH:
        step += 1
        now = cut(now.where("above is not null").join(sections.select(F.col("id").alias("above"), F.col("parent_id").alias("next")), "above").select("id", "above", "next"))
        if now.isEmpty():
            break
        rows = rows.unionByName(now.select("id", F.col("above").alias("other"), F.lit(-step).alias("step")))
        now = now.select("id", F.col("next").alias("above"))
    kids = own.select("id").join(sections.select(F.col("parent_id").alias("id"), F.col("id").alias("other")), "id").select("id", "other", F.lit(1).alias("step"))
    listed = rows.unionByName(kids).join(cost, "other").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("step", "byte_start", "other", "tokens"))).alias("xs"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("ids"))
    taken = F.aggregate("xs", start, lambda s, x: F.when(s["used"] + x["tokens"] <= max_tokens, F.struct((s["used"] + x["tokens"]).alias("used"), F.concat(s["ids"], F.array(x["other"])).alias("ids"))).otherwise(s))
    kept = listed.select("id", "xs", taken["ids"].alias("ids"))
    out = kept.select("id", F.explode(F.filter("xs", lambda x: F.array_contains("ids", x["other"]))).alias("x"))
    part = F.when(F.col("x.step") < 0, "ancestor").when(F.col("x.step") == 0, "self").otherwise("child")
    return out.select("id", "x.other", part.alias("part"), "x.tokens")


def descendants(sections: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth of the sections under some (id), without themselves."""
    down = sections.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    return bfs(down, roots.select(F.col("id").alias("node")), max_depth).where("depth > 0")


def neighbours(sections: DataFrame, wanted: DataFrame, most: int = 10, cousins: bool = False) -> DataFrame:
    """id, kind, other: parent, children, siblings and, if asked for, cousins of the wanted sections (id), the first `most` of a kind by id."""
    own = sections.join(wanted.select("id").distinct(), "id", "left_semi").select("id", F.col("parent_id").alias("above"))
    all_ = sections.select(F.col("id").alias("other"), F.col("parent_id").alias("of"))
    up = own.where("above is not null")
    kinds = [
        up.select("id", F.lit("parent").alias("kind"), F.col("above").alias("other")), own.join(all_, own.id == all_.of).select("id", F.lit("child").alias("kind"), "other"),
        up.join(all_, up.above == all_.of).where("id <> other").select("id", F.lit("sibling").alias("kind"), "other")]
    if cousins:
        grand = up.join(all_.select(F.col("other").alias("above"), F.col("of").alias("top")), "above")
        aunts = grand.join(all_.select(F.col("of").alias("top"), F.col("other").alias("aunt")), "top").where("aunt <> above")
        kinds.append(aunts.join(all_.select(F.col("of").alias("aunt"), "other"), "aunt").select("id", F.lit("cousin").alias("kind"), "other"))
    found = kinds[0]
    for k in kinds[1:]:
        found = found.unionByName(k)
    return found.withColumn("r", F.row_number().over(Window.partitionBy("id", "kind").orderBy("other"))).where(F.col("r") <= most).drop("r")


def summary(title: Column, content: Column, most: int = 120) -> Column:
    """The first sentence of the first line of prose, at most so many characters; the title where there is none."""
    line = F.trim(F.regexp_extract(F.regexp_replace(content, r"(?m)^\s*(?:#.*|```.*|[-*>|].*)$", ""), r"(?s)^\s*([^\n]*)", 1))
    first = F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.substring(F.when(first != "", first).when(line != "", line).otherwise(title), 1, most)


def code_examples(blocks: DataFrame, terms: list[str], lang: str | None = None, path_glob: str | None = None, top: int = 10) -> DataFrame:
    """id, score: the best code blocks (id, doc, lang, words) by BM25 over their words, language and documents chosen before scoring."""
    from sextant.operators.predicates import path_matches
    from sextant.operators.search import bm25

    kept = blocks.where(F.size("words") > 0)
    if lang is not None:
        kept = kept.where(F.lower(F.trim("lang")) == lang.strip().lower())
    if path_glob is not None:
        kept = kept.where(path_matches(F.col("doc"), path_glob))
    return bm25(kept.select("id", "words"), terms, 1.2, 0.75).orderBy(F.desc("score"), "id").limit(top)


def structure(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: code blocks (lang, content) that swallowed headings, and headings that skip a level in their document's order."""
    swallowed = blocks.where(~F.lower(F.coalesce("lang", F.lit(""))).isin("md", "markdown", "mdx") & F.col("content").rlike(r"(?m)^#{2,6}\s")).agg(F.count(F.lit(1)).alias("swallowed"))
    before = F.lag("level").over(Window.partitionBy("doc").orderBy("byte_start", "id"))
    skips = sections.where("level > 0").withColumn("jump", F.col("level") - before).agg(F.count(F.when(F.col("jump") > 1, 1)).alias("level_skips"))
    return swallowed.crossJoin(skips).select("swallowed", "level_skips", (F.col("swallowed") + F.col("level_skips")).alias("warnings"))  # one row each


def health(sections: DataFrame, roles: DataFrame, states: DataFrame, broken: DataFrame, orphans: DataFrame, blocks: DataFrame) -> DataFrame:
    """measure, what, n: sections and documents, roles (id, role), freshness (id, state), broken links, orphans and structural warnings."""
    row = lambda df, measure, what, n: df.select(F.lit(measure).alias("measure"), what.cast("string").alias("what"), n.cast("long").alias("n"))
    one = lambda df, measure: row(df.agg(F.count(F.lit(1)).alias("n")), measure, F.lit(""), F.col("n"))
    by = lambda df, measure, key: row(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), measure, F.col(key), F.col("n"))
    warned = structure(sections, blocks)
    return (one(sections, "sections").union(one(sections.select("doc").distinct(), "documents")).union(by(roles, "role", "role")).union(by(states, "freshness", "state")).union(one(broken, "broken_links"))
            .union(one(orphans, "orphans")).union(row(warned, "structure", F.lit("warnings"), F.col("warnings"))))


def blast_radius(links: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """node, depth: documents that lead to the targets (node) through links (src, target) between documents, directly or through others."""
    return bfs(links.select(F.col("target").alias("src"), F.col("src").alias("dst")), targets, depth).where("depth > 0")


# Inbound documents, over all steps, from which a deletion is blocked; days in which an edit is recent.
MANY_LINKS, RECENT_DAYS = 3, 14


def delete_check(sections: DataFrame, tutorial: DataFrame, anchors: DataFrame, inbound: DataFrame, edits: DataFrame) -> DataFrame:
    """id, verdict, blockers: whether sections can go, the strongest blocker first.

    tutorial: (id) on a reading path; anchors: (id, n) links to the section
    itself; inbound: (doc, n) documents that lead to its document within the
    depth that was walked; edits: (id, days_ago).
    """
    marked = (sections.select("id", "doc").join(tutorial.select("id").distinct().withColumn("path", F.lit(True)), "id", "left").join(anchors.select("id", F.col("n").alias("anchors")), "id", "left")
              .join(inbound.select("doc", F.col("n").alias("inbound")), "doc", "left").join(edits.groupBy("id").agg(F.min("days_ago").alias("days")), "id", "left"))
    tests = {"tutorial_path_membership": F.col("path"), "anchor_reference": F.col("anchors") > 0, "transitive_backlinks": F.col("inbound") >= MANY_LINKS, "recently_edited": F.col("days") <= RECENT_DAYS}
    verdicts = dict(zip(tests, ("tutorial_path_blocking", "anchor_referenced", "backlinks_blocking", "recently_edited_blocking"), strict=True))
    blockers = F.array_compact(F.array(*[F.when(c, k) for k, c in tests.items()]))
    return marked.select("id", F.coalesce(*[F.when(c, verdicts[k]) for k, c in tests.items()], F.lit("safe_to_delete")).alias("verdict"), F.array_join(blockers, ",").alias("blockers"))


def code_links(blocks: DataFrame, symbols: DataFrame) -> DataFrame:
    """section, symbol, uses: names called in code blocks (section, content) joined with symbols (symbol, name)."""
    called = blocks.select("section", F.explode(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("name"))
    return called.groupBy("section", "name").agg(F.count(F.lit(1)).alias("uses")).join(symbols, "name").select("section", "symbol", "uses")


def undocumented(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """symbol of symbols (symbol, name) whose name no inline code (section, code) is, parentheses left out."""
    named = spans.select(F.regexp_replace("code", r"\(\)$", "").alias("name")).distinct()
    return symbols.join(named, "name", "left_anti").select("symbol")


def stale_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """page, source, reason: sources that pages (page, sources array of (path, hash)) name and that are gone or have another hash in sources (path, hash)."""
    named = pages.select("page", F.inline("sources")).select("page", F.col("path").alias("source"), F.col("hash").alias("was"))
    both = named.join(sources.select(F.col("path").alias("source"), F.col("hash").alias("now")), "source", "left")
    return both.where("now is null or now <> was").select("page", "source", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("reason"))


def recent_changes(states: DataFrame, stale: bool = True, edited: bool = True) -> DataFrame:
    """id, state of (id, state): what drifted from the index, of the kinds asked for."""
    wanted = ["stale"] * stale + ["edited"] * edited
    return states.where(F.col("state").isin(wanted))


def wiki_stats(sections: DataFrame, links: DataFrame) -> DataFrame:
    """One row: documents, sections, links, mean links a document, documents without any link out."""
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    docs = sections.groupBy("doc").agg(F.count(F.lit(1)).alias("sections")).join(out.withColumnRenamed("src", "doc"), "doc", "left")
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.sum("sections").alias("sections"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean_links"), F.count(F.when(F.col("n").isNull(), 1)).alias("silent"))


def combined_score(title: Column, body: Column, meaning: Column) -> Column:
    """How alike two sections are: 0.60 cosine, 0.25 body, 0.15 title; without a cosine 0.70 body, 0.30 title; 4 places."""
    return F.round(F.when(meaning.isNotNull(), 0.60 * meaning + 0.25 * body + 0.15 * title).otherwise(0.70 * body + 0.30 * title), 4)
