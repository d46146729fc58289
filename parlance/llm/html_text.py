"""Main text of web pages: the page's structure, and where that does not tell,
the runs of tokens that many pages of the host share, found by suffix arrays.

The pages of a host are dealt by the hash of their url into groups of about
``GROUP_BYTES`` (a hot host into many). In a group the pages' token streams
are concatenated, and their suffixes are ordered by their first ``RUN``
tokens (``suffix_order``; deeper order is not needed: a token lies in a
substring of at least RUN tokens that repeats on distinct pages exactly if
it lies in such a run of RUN tokens). A group gives every run once with its
pages; of a host with several groups, the runs that are common in one of
them are counted over all its pages, so the result does not depend on how the
pages are dealt. Runs are told apart by 64-bit hashes. Every page of every
host takes part, with an article or without one.

Structure settles what a repeated run cannot tell: blocks inside an
article stay, though another page may carry the same article; blocks inside
menus, page headers and footers, sidebars, notices, adverts, forms and
comments go, though their words may be unique; scripts, styles and markup are
never text. An element is one of these by its tag, or by a name all of whose
words say so (``named_roles``). On a page with an article other blocks go too; the runs tell
which of what is left out is the host's template (``n_repeated``). On a page without
one a block goes only as a whole: if each of its tokens lies in a run that is
on at least MANY distinct pages and on one page in SHARE. A block that is
partly covered stays whole, and a page of nothing but repeats keeps them.

Rows of one url are one page, so repeated rows are no boilerplate for each
other. A null or empty page has an empty text; a null url has an empty host
and its rows are distinct pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import written
from parlance.llm.url_filter import host_of
from parlance.llm.words import mix, seeds

RUN = 6
#: A template's run is on at least so many distinct pages of its host, and on one page in so many.
MANY, SHARE = 3, 10
GROUP_BYTES = 1 << 20
#: Codec of the packed tokens, page by page.
PACKED_BY = "zstd"
#: Compared hosts up to which their list is broadcast (some 10 MB); a longer one is joined by a shuffle.
BROADCAST_HOSTS = 100_000

TOKEN = re.compile(
    r"[^<]+|<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|head(?=[\s>]))\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?"
    r"|<[!?][^>]*>?|<", re.S | re.I)
#: Of TOKEN's groups the last one that an element's tag matches.
ATTRIBUTES = TOKEN.groupindex["attributes"]
# Html elements by their role.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead
title tr ul""".split())
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
MAIN = frozenset(["article", "main"])
ASIDE = frozenset(["aside", "dialog", "footer", "form", "header", "menu", "nav"])
#: Inline elements that are no text.
CONTROLS = frozenset(["button", "label"])
#: Of these an article inside is an article nevertheless (pages wrapped in a form, unclosed menus).
WRAPPERS = frozenset(["form", "header", "label", "menu", "nav"])
# Words of class names and ids that say what an element is, and words that only say where or in what form.
ROLES = frozenset("""ad ads advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs comment commentlist comments consent
cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion
related replies reply share sharing sidebar skip social sponsor sponsored sponsors subscribe toolbar widget widgets""".split())
FORMS = frozenset("""area bar block bottom box button buttons container fixed form group icons inner left link links list main mobile outer page panel
primary right secondary section site sticky thread top wrap wrapper""".split())
#: Roles that an article's own parts may be named by.
OWN_PARTS = frozenset(["header", "masthead"])
#: On an article itself only these make it something else: a comment, or an advert.
NOT_MAIN = frozenset(["ad", "ads", "comment", "comments", "promo", "related", "reply"])
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

ARTICLE, OUTSIDE, OTHER = 1, -1, 0


def named_roles(attributes: str) -> set[str]:
    """The roles that an element's names state. A name counts only if each of
    its words is a role, a form or a number: ``share-bar``, not ``share-price``."""
    out: set[str] = set()
    for names in NAMES.findall(attributes):
        for name in "".join(names).lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if all(w in ROLES or w in FORMS or w.isdigit() for w in words):
                out.update(w for w in words if w in ROLES)
    return out


def closed_tags(tokens: list[re.Match]) -> set[int]:
    """The places of start tags whose end tag follows."""
    started: dict[str, list[int]] = {}
    out = set()
    for i, m in enumerate(tokens):
        if m.lastindex != ATTRIBUTES:
            continue
        _, close, tag, _ = m.groups()
        if not close:
            started.setdefault(tag.lower(), []).append(i)
        elif started.get(tag.lower()):
            out.add(started[tag.lower()].pop())
    return out


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(role, text) of every non-empty block in page order: ARTICLE, OUTSIDE or OTHER.

    Inline elements that are no text (buttons, labels, and those whose names
    say so) are OUTSIDE blocks of their own, and the block around them goes
    on; without an end tag they end with that block."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open containers and the role inside
    role = OTHER
    tokens = list(TOKEN.finditer(page))
    closed: set[int] | None = None  # found when an inline element asks for it
    muted: list[str] = []  # the inline element that is no text, and those of its kind inside
    muted_parts: list[str] = []
    muted_closes = False

    def flush(of: int, texts: list[str]):
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            out.append((of, text))
        texts.clear()

    for i, m in enumerate(tokens):
        if m.lastindex != ATTRIBUTES:
            piece = m[0]
            if piece[0] != "<" or len(piece) == 1:
                (muted_parts if muted else parts).append(piece)
            elif m["raw"] and m["raw"].lower() in ("textarea", "select", "head") and not muted and parts:
                flush(role, parts)
            continue
        _, close, tag, attributes = m.groups()
        tag, opens = tag.lower(), not close and not attributes.endswith("/")
        if muted:
            if tag == muted[0]:
                muted.append(tag) if opens else muted.pop()
                if muted:
                    continue
                flush(OUTSIDE, muted_parts)
                parts.append(" ")
                continue
            if tag in BLOCKS and (not muted_closes or (opens and tag in MAIN and muted[0] in WRAPPERS)):
                muted.clear()
                flush(OUTSIDE, muted_parts)
            else:
                muted_parts.append(" " if tag in BLOCKS or tag == "br" else "")
                continue
        roles = named_roles(attributes) if opens and attributes and tag not in ("html", "body", "main") else None
        if roles:
            if tag == "article":
                roles &= NOT_MAIN
            elif stack and stack[-1][1] == ARTICLE:
                roles -= OWN_PARTS
        if tag in BLOCKS:
            if parts:
                flush(role, parts)
        elif tag == "br":
            parts.append(" ")
        elif opens and tag not in ("img", "input", "meta", "link") and (tag in CONTROLS or roles):
            muted.append(tag)
            closed = closed_tags(tokens) if closed is None else closed
            muted_closes = i in closed
            parts.append(" ")
            continue
        if tag not in CONTAINERS and not roles and not (stack and stack[-1][0] == tag):
            continue
        if close:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    del stack[at:]
                    break
                if stack[at][0] in MAIN and tag not in ("body", "html"):
                    break  # a stray end tag does not close the article
        elif opens and tag not in ("img", "input", "br", "hr", "meta", "link"):
            if stack and stack[-1][0] == "p" and tag in BLOCKS:
                stack.pop()
            before = stack[-1][1] if stack else OTHER
            inside = before
            if roles or (tag in ASIDE and not (tag == "header" and before == ARTICLE)):
                inside = OUTSIDE
            elif tag in MAIN and (before != OUTSIDE or stack[-1][0] in WRAPPERS):
                inside = ARTICLE
            stack.append((tag, inside))
        role = stack[-1][1] if stack else OTHER
    flush(OUTSIDE, muted_parts)
    flush(role, parts)
    return out


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``tokens`` ordered by their first ``depth`` tokens, and the
    rank of each by these, by prefix doubling. It begins with as many tokens as
    one number holds."""
    def joined(first: np.ndarray, second: np.ndarray, at: int) -> np.ndarray:
        out = first * (int(second.max()) + 1)
        out[:max(0, len(out) - at)] += second[at:]  # past the end nothing, which comes first
        return out

    def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(np.diff(keys[order], prepend=-1) != 0)
        return order, rank

    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    single = tokens.astype(np.int64) - int(tokens.min()) + 1
    if int(single.max()) > 2 * len(tokens):
        single = ranked(single)[1]
    keys, done, span = single, 1, int(single.max()) + 1
    while done < depth and span ** (done + 1) < 1 << 63:
        keys, done = joined(keys, single, done), done + 1
    order, rank = ranked(keys)
    while done < depth:
        step = min(done, depth - done)
        order, rank = ranked(joined(rank, rank, step))
        done += step
    return order, rank - 1


def joined_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The texts' tokens as one array of numbers, each text with its own end mark; how many each has; the tokens by number."""
    split = pc.split_pattern(pa.array([t or None for t in texts], pa.large_string()), " ")
    words = split.values.dictionary_encode()
    lengths = np.diff(split.offsets.to_numpy()).astype(np.int64)
    marks = np.cumsum(lengths + 1) - 1
    tokens = np.zeros(len(words) + len(texts), np.int64)
    tokens[marks] = -1 - np.arange(len(texts))  # its own end mark: no run passes it unnoticed
    tokens[tokens == 0] = words.indices.to_numpy()
    return tokens, lengths, words.dictionary


def whole_runs(tokens: np.ndarray, run: int) -> np.ndarray:
    """The places from which on ``run`` tokens pass no end mark."""
    passed = np.append(0, np.cumsum(tokens < 0))
    return np.flatnonzero(passed[run:] == passed[:max(0, len(passed) - run)])


def run_keys(tokens: np.ndarray, names: pa.Array, run: int, places: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``run`` tokens from each of ``places`` on, the same in any group; they pass no end mark."""
    used = np.zeros(len(names), bool)
    for j in range(run):
        used[tokens[places + j]] = True
    hashes = np.zeros(len(names), np.uint64)
    hashes[used] = pd.util.hash_array(names.filter(pa.array(used)).to_numpy(zero_copy_only=False).astype(object), categorize=False)
    keys = np.zeros(len(places), np.uint64)
    for j, c in enumerate(seeds(run, 3) | np.uint64(1)):
        keys += (mix(hashes + np.uint64(j)) * c)[tokens[places + j]]
    return mix(keys).view(np.int64)


def run_counts(texts: list[str], pages: list, run: int = RUN, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Key of every distinct run of ``run`` tokens that occurs on ``least`` distinct pages, and on how many it does."""
    tokens, lengths, names = joined_texts(texts)
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = {p: i for i, p in enumerate(dict.fromkeys(pages))}
    page = np.repeat([number[p] for p in pages], lengths + 1)
    order, rank = suffix_order(tokens, run)
    first = order[np.flatnonzero(np.diff(rank[order], prepend=-1))]
    on = np.sort(rank * len(number) + page)
    n = np.bincount(on[np.diff(on, prepend=-1) != 0] // len(number))
    whole = np.zeros(len(tokens), bool)
    whole[whole_runs(tokens, run)] = True
    common = whole[first] & (n >= least)
    return run_keys(tokens, names, run, first[common]), n[common]


def runs_among(texts: list[str], among: list[tuple[int, np.ndarray]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places in the joined texts of the runs whose key is one of those looked for, these keys, and the texts'
    lengths. ``among``: numbers of neighbouring texts, each with the keys looked for in them."""
    tokens, lengths, names = joined_texts(texts)
    places = whole_runs(tokens, run)
    own = run_keys(tokens, names, run, places)
    ends = np.searchsorted(places, np.append(0, np.cumsum(lengths + 1))[np.cumsum([n for n, _ in among], dtype=np.int64)])
    found = np.zeros(len(places), bool)
    for begin, end, (_, keys) in zip(np.append(0, ends), ends, among, strict=False):
        if len(keys):
            keys, part = np.sort(keys), own[begin:end]
            found[begin:end] = keys[np.minimum(np.searchsorted(keys, part), len(keys) - 1)] == part
    return places[found], own[found], lengths


def tokens_in(texts: list[str], among: list[tuple[int, np.ndarray]], run: int = RUN) -> list[np.ndarray]:
    """Per text: which tokens lie in a run whose key is among those looked for in it."""
    if not texts:
        return []
    starts, _, lengths = runs_among(texts, among, run)
    ends = np.cumsum(lengths + 1)
    covered = np.zeros(int(ends[-1]) + 1, np.int64)
    covered[starts] += 1
    covered[starts + run] -= 1
    flags = np.cumsum(covered)[:-1] > 0
    return [flags[e - n - 1:e - 1] for e, n in zip(ends, lengths, strict=True)]


def repeated_tokens(streams: list[list[str]], pages: list, run: int = RUN, many: int = 2) -> list[np.ndarray]:
    """Per stream: which tokens lie in a run of at least ``run`` tokens that occurs on ``many`` distinct pages."""
    texts = [" ".join(s) for s in streams]
    return tokens_in(texts, [(len(texts), run_counts(texts, pages, run, many)[0])], run)


def many_pages(n_pages: int) -> int:
    """From how many distinct pages on a run is a template's, on a host of ``n_pages``."""
    return max(MANY, -(-n_pages // SHARE))


def stream_of(blocks: list[tuple[int, str]]) -> str:
    """The tokens of all blocks, with a space between them."""
    return " ".join([text for _, text in blocks])


def n_tokens(stream: str) -> int:
    return stream.count(" ") + 1 if stream else 0


def is_open(blocks: list[tuple[int, str]]) -> bool:
    """Repeats decide: there is no article, but there are blocks of no clear role."""
    roles = {role for role, _ in blocks}
    return OTHER in roles and ARTICLE not in roles


def open_text(blocks: list[tuple[int, str]], flag: np.ndarray) -> tuple[str, int]:
    """Main text of an open page, and the tokens of the blocks left out as repeated."""
    kept, every, dropped, at = [], [], 0, 0
    for role, text in blocks:
        n = text.count(" ") + 1
        if role == OTHER:
            every.append(text)
            if flag[at:at + n].all():
                dropped += n
            else:
                kept.append(text)
        at += n
    # All of it repeats: nothing tells template from text, such as one story at many urls.
    return ("\n".join(kept), dropped) if kept else ("\n".join(every), 0)


def article_text(blocks: list[tuple[int, str]]) -> str:
    return "\n".join(text for role, text in blocks if role == ARTICLE)


def page_text(blocks: list[tuple[int, str]], flag: np.ndarray) -> tuple[str, int]:
    """Main text of a page, and the tokens of the blocks left out that repeat as a whole. The structure of a
    page with an article is certain: it keeps what repeats inside, and leaves out what is unique outside."""
    if is_open(blocks):
        return open_text(blocks, flag)
    dropped, at = 0, 0
    for role, text in blocks:
        n = text.count(" ") + 1
        dropped += n if role != ARTICLE and flag[at:at + n].all() else 0
        at += n
    return article_text(blocks), dropped


def extract_group(pages: list[str], urls: list, run: int = RUN) -> list[tuple[str, int, int]]:
    """Per page of a whole host: main text, tokens and tokens of the blocks left out as repeated."""
    parsed = [blocks_of(p) for p in pages]
    streams = [stream_of(blocks) for blocks in parsed]
    flags = repeated_tokens([s.split() for s in streams], urls, run, many_pages(len(set(urls))))
    found = [page_text(blocks, flag) for blocks, flag in zip(parsed, flags, strict=True)]
    return [(text, n_tokens(stream), dropped) for (text, dropped), stream in zip(found, streams, strict=True)]


def runs_on_pages(texts: list[str], pages: list, among: list[tuple[int, np.ndarray]], run: int = RUN) -> pd.DataFrame:
    """``text``, ``_run`` and ``_page``: the keys looked for that occur, each once with its distinct pages and a text there."""
    places, keys, lengths = runs_among(texts, among, run)
    text = np.searchsorted(np.cumsum(lengths + 1), places, side="right")
    found = pd.DataFrame({"text": text, "_run": keys}).drop_duplicates()
    return found.assign(_page=pd.Series([pages[i] for i in found["text"]], index=found.index, dtype=object))


def by_host(frame: pd.DataFrame, runs: str) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The rows of hosts that have ``runs``, host by host, and how many of them have which runs."""
    hosts = [places for places in frame.groupby("_host").indices.values() if frame[runs].iloc[places[0]] is not None]
    among = [(len(places), np.asarray(frame[runs].iloc[places[0]], np.int64)) for places in hosts]
    return np.concatenate(hosts) if hosts else np.zeros(0, np.int64), among


def template_runs(source: DataFrame, hosts: DataFrame, few: bool, run: int) -> DataFrame:
    """``_host`` and ``_run``: keys of the runs that many pages of the whole host share.

    A run on one page in SHARE of the host is on one in SHARE of a group's
    pages in some group at least, so each group names those that are common in
    it; of the hosts with several groups, the named are then counted in all."""
    def rows(frame: pd.DataFrame, keys: np.ndarray, n: np.ndarray, total: int) -> pd.DataFrame:
        # A row without a key counts the pages.
        host = pd.Series([frame["_host"].iloc[0]] * (len(keys) + 1), dtype=object)
        return pd.DataFrame({"_host": host, "_groups": frame["_groups"].iloc[0], "_run": pd.array([*keys.tolist(), None], dtype="Int64"), "n": [*n.tolist(), total]})

    def common(frame: pd.DataFrame) -> pd.DataFrame:
        codec = pa.Codec(PACKED_BY, compression_level=1)
        streams = [codec.decompress(t, size, asbytes=True).decode() if size else "" for t, size in zip(frame["_text"], frame["_size"], strict=True)]
        pages = frame["_page"].tolist()
        total = len(set(pages))
        least = many_pages(total) if frame["_groups"].iloc[0] == 1 else -(-total // SHARE)
        return rows(frame, *run_counts(streams, pages, run, least), total)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows_of, among = by_host(frame, "_named")
            part = frame.iloc[rows_of]
            found = runs_on_pages([stream_of(blocks_of(p)) for p in part["_html"]], part["_page"].tolist(), among, run)
            found = found.assign(_host=part["_host"].astype(object).to_numpy()[found["text"]])
            yield found[["_host", "_run", "_page"]].drop_duplicates()

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = pa.Codec(PACKED_BY, compression_level=1)
        for frame in frames:
            texts = [stream_of(blocks_of(p)).encode() for p in frame["_html"]]
            out = pd.DataFrame({
                "_host": frame["_host"].astype(object), "_page": frame["_page"].astype(object),
                "_size": [len(t) for t in texts], "_text": [codec.compress(t, asbytes=True) if t else b"" for t in texts]})
            yield out.drop_duplicates()

    # Only the packed tokens are shuffled. Rows of one url are in one group, so the groups' pages add up; equal rows of a url count once.
    pages = source.select("_host", F.coalesce("url", F.concat(F.lit("row "), F.coalesce("_id", F.lit("")), F.lit(" "), F.md5("_html"))).alias("_page"), "_html")
    groups = dealt(pages.mapInPandas(packed, "_host string, _page string, _size bigint, _text binary"), hosts, few, F.xxhash64("_page"))
    groups = groups.groupBy("_host", "_groups", "_group", "_page", F.md5("_text").alias("_hash")).agg(F.first("_size").alias("_size"), F.first("_text").alias("_text"))
    first = written(groups.groupBy("_host", "_group").applyInPandas(common, "_host string, _groups int, _run bigint, n bigint"), "html-runs")
    totals = first.where("_run IS NULL").groupBy("_host").agg(F.greatest(F.lit(MANY), F.ceil(F.sum("n") / SHARE)).alias("_many"))
    named = first.where("_run IS NOT NULL AND _groups > 1").groupBy("_host").agg(F.collect_set("_run").alias("_named"))
    several = pages.join(named, "_host").mapInPandas(count, "_host string, _run bigint, _page string").groupBy("_host", "_run").agg(F.countDistinct("_page").alias("n"))
    several = several.join(totals, "_host").where("n >= _many").select("_host", "_run")
    return first.where("_run IS NOT NULL AND _groups = 1").select("_host", "_run").unionByName(several)


def dealt(rows: DataFrame, hosts: DataFrame, few: bool, by: Column) -> DataFrame:
    """The rows of ``hosts`` with their ``_group``, dealt by the number ``by``."""
    return (
        rows.join(F.broadcast(hosts) if few else hosts, "_host")
        .withColumn("_group", F.pmod(by, F.col("_groups")).cast("int"))
        .repartition("_host", "_group")
    )


def extract_text(pages: DataFrame, id_col: str, url_col: str, html_col: str, run: int = RUN, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row: ``id_col``, ``url``, ``text``, ``n_chars``, ``n_tokens`` of all blocks and ``n_repeated`` of those left out that repeat on many pages of the host."""
    source = pages.select(F.col(id_col).cast("string").alias("_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    source = source.withColumn("_host", host_of(F.col("url")))

    # Every page of every host is compared.
    hosts = source.groupBy("_host").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("_html")) / group_bytes)).cast("int").alias("_groups"))
    hosts = written(hosts, "html-hosts")
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = [blocks_of(p) for p in frame["_html"]]
            streams = [stream_of(blocks) for blocks in parsed]
            sizes = [n_tokens(s) for s in streams]
            flags = [np.zeros(n, bool) for n in sizes]
            rows_of, among = by_host(frame, "_runs")
            for i, flag in zip(rows_of, tokens_in([streams[i] for i in rows_of], among, run), strict=True):
                flags[i] = flag
            found = [page_text(blocks, flag) for blocks, flag in zip(parsed, flags, strict=True)]
            yield pd.DataFrame({"_id": frame["_id"].astype(object), "url": frame["url"].astype(object), "text": pd.Series([t for t, _ in found], dtype=object), "n_tokens": sizes, "n_repeated": [n for _, n in found]})

    shared = written(template_runs(source, hosts, few, run).groupBy("_host").agg(F.collect_list("_run").alias("_runs")), "html-templates")
    out = source.join(shared, "_host", "left").mapInPandas(finish, "_id string, url string, text string, n_tokens bigint, n_repeated bigint")
    return out.select(F.col("_id").cast(pages.schema[id_col].dataType).alias(id_col), "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_tokens", "n_repeated")
