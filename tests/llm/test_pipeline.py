"""Each stage of the pipeline against a plain version of it, on what the stage before it kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from millrace.llm import quality_rules
from millrace.llm.common import table, written
from tests.llm.test_native import hits_by_hand, rules_by_hand
from tests.llm.test_near import groups_by_hand
from tests.llm.test_tokens import BYTES, check_packing, ids_of

SPACE = " \t\n\x0b\x0c\r"


def line_fails(line):
    ws = re.findall(f"[^{SPACE}]+", line)
    n, alone = len(ws), "|/\\\\·•∙‣»«›‹>→⇒~–—"
    if not n:
        return False
    over = max(len(re.findall(r"\|", line)), len(re.findall(r"[#*$%&|<>]+", line)), len(re.findall("!{2,}", line))) > 0.25 * n
    parts = sum(not set(w) - set(alone) for w in ws)
    boxes = re.findall(r"\[[^\[\]]+\]", line)
    menu = parts >= 2 and n - parts <= 3 * (parts + 1) or len(boxes) >= 3 and 4 * (len(line) - sum(map(len, boxes))) <= len(line)
    closed = re.search(f"[.!?:;\"'»”)…。！？][{SPACE}]*$", line)
    titled = sum(w[0].isupper() for w in ws) >= 0.8 * n
    notice = any(p in line.lower() for p in quality_rules.BOILERPLATE)
    return over or menu or len(line) <= quality_rules.NOTICE_CHARS and ((n <= 3 or titled) and not closed or notice)


def quality(rows):
    for r in rows:
        n, *_, repeated = rules_by_hand(r["text"])
        failing = [x for x in (r["text"] or "").split("\n") if line_fails(x)]
        lost = sum(len(re.findall(f"[^{SPACE}]+", x)) for x in failing)
        if n >= 10 and 100 * repeated <= 20 * n and lost <= 0.5 * n:
            yield r | {"text": "\n".join(x for x in (r["text"] or "").split("\n") if not line_fails(x))}


def site_lines(rows):
    pages, seen = Counter(r["source"] for r in rows), defaultdict(Counter)
    for r in rows:
        seen[r["source"]].update({x.strip(" ") for x in r["text"].split("\n")} - {""})
    for r in rows:
        often = {x for x, n in seen[r["source"]].items() if n >= 5 and n > 0.1 * pages[r["source"]]}
        yield r | {"text": "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in often)}


def near_duplicates(rows):
    """Of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more the least id stays."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    label = groups_by_hand([r["text"] for r in rows])
    return [r for i, r in enumerate(rows) if label[i] == i]


def decontaminate(rows, bench):
    word = "[\x30-\x39\x41-\x5a\x61-\x7a\x80-\U0010ffff]+"
    for r, (n, hit, _) in zip(rows, hits_by_hand([r["text"] for r in rows], bench), strict=True):
        if hit and 20 * hit >= n:
            continue
        if hit:
            words = [m[0].lower() for m in re.finditer(word, r["text"])]
            wins = {tuple(w[k : k + 13]) for _, t in bench for w in [[m[0].lower() for m in re.finditer(word, t or "")]] for k in range(max(1, len(w) - 12))}
            gone = {j for x in wins for k in range(len(words) - len(x) + 1) if tuple(words[k : k + len(x)]) == x for j in range(k, k + len(x))}
            parts = re.findall(f"{word}[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*", r["text"])
            lead = r["text"][: re.search(word, r["text"]).start()]
            r = r | {"text": lead + "".join(p for i, p in enumerate(parts) if i not in gone)}
        yield r


def test_stages_against_plain_versions(spark, small):
    bench = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    docs = table(spark, small, "documents")
    plain = {"quality_rules": quality, "line_dedup": site_lines, "simhash_near_dedup": near_duplicates, "decontamination": lambda rows: decontaminate(rows, bench)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [r.asDict() for r in docs.collect()]
        want = {r["doc_id"]: r | {"n_chars": len(r["text"])} for r in plain[name](rows)}
        out = written(stage(spark, docs, small), name)
        assert out.columns == docs.columns
        assert {r.doc_id: r.asDict() for r in out.collect()} == want, name
        docs = out
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, small).collect(), ids_of(rows, BYTES, 0))


def test_stages_of_odd_tables(spark, small):
    """Null and empty texts, repeated rows, a null id and clashing columns go through all stages; so does an empty table."""
    prose = [f"{w} said plainly that number {i} of the many reports was read in full by all of them, every word of it, on a quiet day in the house by the {w} river." for i, w in enumerate("green blue red white black".split())]
    clash = ["row", "row_number", "judged", "kept", "bitmap", "component", "spans", "n_lines", "left"]
    rows = [(1, None, "a"), (2, "", "a"), (3, prose[0], "a"), (3, prose[0], "b"), (None, prose[1], None), (5, prose[2], "b"), (6, "\n".join(prose * 40), "b")]
    docs = spark.createDataFrame([(*r, *("x" for _ in clash)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in clash))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, small), name)
            assert now.columns == docs.columns
            assert now.where(" or ".join(f"cast({c} AS string) <> 'x'" for c in clash)).isEmpty()
        ids = sorted((r.doc_id for r in now.collect()), key=repr)
        assert ids == ([] if start is not docs else [3, 5, None])
        assert sorted({r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, small).collect()}, key=repr) == ids


def test_run_leaves_its_result_alone(spark, small):
    from pathlib import Path

    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "millrace"
    before = set(root.iterdir())
    out = corpus_pipeline.run(spark, small)
    assert len(set(root.iterdir()) - before) == 1 and out.count() > 100
