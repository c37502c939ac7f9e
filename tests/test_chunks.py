"""Chunks against a plain reading of the rules, line by line."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.functions import chunking
from mnemospark.functions import text as tx
from mnemospark.plans import search

BODY = "word " * 20


def loop_lines(text):
    """(path, body) of sections, with indents, fences and headings read character by character."""
    out, stack, body, fence = [], [], [], None
    for line in text.split("\n"):
        width = 0
        for c in line:
            if c == " ":
                width += 1
            elif c == "\t":
                width += 4
            else:
                break
        start = line.lstrip()
        run = len(start) - len(start.lstrip(start[0])) if start and start[0] in "`~#" else 0
        kind = start[0] if run and width < 4 else ""
        rest = start[run:]
        if fence:
            if kind == fence[0] and run >= fence[1] and not rest.strip():
                fence = None
        elif kind in ("`", "~") and kind and run >= 3 and not (kind == "`" and "`" in rest):
            fence = (kind, run)
        elif kind == "#" and run <= 6 and rest[:1] in (" ", "\t") and rest:
            if "\n".join(body).strip():
                out.append((" > ".join(t for _, t in stack) if stack else None, "\n".join(body)))
            body = []
            while stack and stack[-1][0] >= run:
                stack.pop()
            stack.append((run, rest.strip()))
            continue
        body.append(line)
    if "\n".join(body).strip():
        out.append((" > ".join(t for _, t in stack) if stack else None, "\n".join(body)))
    return out


def loop_windows(body, size, overlap):
    out, at = [], 0
    while True:
        out.append(body[at : at + size])
        if at + size >= len(body):
            return out
        at += size - overlap


def loop_chunks(text, markdown):
    pieces, current = [], None  # current: [path, text]

    def flush():
        nonlocal current
        if current:
            if len(current[1].encode()) < 64 and pieces and pieces[-1][0] == current[0]:
                pieces[-1][1] += "\n\n" + current[1]
            else:
                pieces.append(current)
        current = None

    for path, body in loop_lines(text) if markdown else [(None, p) for p in text.split("\n\n")]:
        body = body.strip()
        if not body:
            continue
        if len(body.encode()) > 800:
            flush()
            pieces += [[path, w] for w in loop_windows(body, 800, 200)]
        elif current and current[0] == path and len(current[1].encode()) + len(body.encode()) + 2 <= 800:
            current[1] += "\n\n" + body
        else:
            flush()
            current = [path, body]
    flush()
    out = []
    for path, body in pieces:
        if markdown and len(body.strip()) < 40:
            continue
        whole = (f"{path}\n\n{body}" if path is not None else body).strip()
        size, fits = 1530, lambda parts: all(chunking.token_estimate(p) <= 512 for p in parts)
        parts = [whole]
        while not fits(parts) and size >= 64:
            parts = loop_windows(whole, size, min(200, size // 4))
            size //= 2
        out += [(path, p) for p in (parts if fits(parts) else loop_windows(whole, 64, 16))]
    return out


CASES = [
    f"# A\n\n{BODY}\n\n## B\n\n```\n# no heading\n\n{BODY}\n```\n\n# C\n\n{'x' * 2000}",
    f"# A\n~~~\n# no heading\n```\n~~~\n{BODY}",
    f"````\n```\n# inner\n```\n# still inner\n````\n# outer\n{BODY}",
    f"# A\n\n{BODY}\n\n{BODY}\n\n{BODY * 8}\n\n## B\n\n{BODY}\n# C\n{BODY}",
    f"```unclosed\n# x\n{BODY}",
    f"    # code, not a heading\n\t# nor this\n   ### deep\n{BODY}\n#nospace {BODY}\n####### seven {BODY}",
    f"`` ``` `` inline\n# A\n{BODY}\n``` not ` a fence\n# B\n{BODY}",
    f"# Only a heading\n## Another\n\n{BODY}\n\n# License\n\nMIT.",
    "日本語のテキスト。" * 300,
    f"{BODY * 5}\n\ntiny\n\n{BODY * 7}\n\nend",
    "",
    "# x",
]


@pytest.mark.parametrize("markdown", [True, False])
def test_chunks_match_a_loop(markdown):
    for text in CASES:
        assert list(chunking.chunks_of(text, markdown)) == loop_chunks(text, markdown), text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["# a", "## b", "### c", "```", "````", "~~~", "~~~~", " ```x", "    # d", "\t~~~", "", "text", BODY, BODY * 9, "``` `", "#", "~~~ x"]), max_size=14), st.booleans())
def test_any_lines_match_a_loop(lines, markdown):
    text = "\n".join(lines)
    assert list(chunking.chunks_of(text, markdown)) == loop_chunks(text, markdown)


def test_pages_and_documents_match_a_loop(spark):
    """The query's chunks of whole tables."""
    sf = "/root/testdata/sf0.001"
    got = {(r.id, r.chunk_index, r.heading_path, r.text, r.chunk_hash) for r in search.chunks(spark, sf).collect()}
    docs = search.knowledge(spark, sf).select("id", tx.normalised(F.col("text")).alias("t"), F.when(F.col("seq") % 2 == 0, "markdown").alias("label"))
    pages = search.table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), tx.normalised(search.page_markdown(F.col("html"))).alias("t"), F.lit("markdown").alias("label"))
    want = set()
    for r in docs.unionByName(pages).collect():
        for n, (path, body) in enumerate(loop_chunks(r.t or "", r.label == "markdown")):
            want.add((r.id, n, path, body, hashlib.sha256(body.encode()).hexdigest()))
    assert got == want
    assert any(path for _, _, path, _, _ in got)


def test_chunks_in_sql(spark):
    chunking.register_chunks(spark)
    spark.createDataFrame([("a", CASES[0], "markdown"), ("b", CASES[3], None), ("c", None, "markdown")], "id string, text string, language string").createOrReplaceTempView("notes")
    got = spark.sql("select n.id, c.chunk_index, c.heading_path, c.text from notes n, lateral chunks(n.text, n.language) c").collect()
    want = {(i, n, path, body) for i, text, md in (("a", CASES[0], True), ("b", CASES[3], False)) for n, (path, body) in enumerate(loop_chunks(text, md))}
    assert {tuple(r) for r in got} == want


def test_chunks_fit_the_ceiling():
    text = " ".join(f"w{n}" for n in range(900)) + "".join(f"{n:05}" for n in range(800)) + "".join(map(chr, range(0x4E00, 0x4E00 + 900)))
    pieces = chunking.fitting(text, 100)
    assert all(chunking.token_estimate(p) <= 100 for p in pieces)
    at = 0
    for piece in pieces:  # each begins inside or right behind what the ones before it hold
        spot = text.find(piece, max(0, at - len(piece)))
        assert spot <= at
        at = max(at, spot + len(piece))
    assert at == len(text)
