"""Times some headline queries in plain single-machine Python (pandas, one process) over the same tables as bench.py, and prints one JSON line.

This is the yardstick for bench.py: the same rows, computed in the way one would without Spark. Environment: BENCH_SF_DIR as there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd

from tesserae.functions.signals import FLAGS
from tesserae.functions.text import lexicon_pattern

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SHORT = {"awards": "cleaned_nsf_awards_2000_2025", "edges": "award_pi_edges", "benchmark": "methodkg_labeled_benchmark_v3_modeling", "flagged": "nsf_awards_with_methodology_flags"}


def table(name: str, *cols: str) -> pd.DataFrame:
    return pd.read_parquet(f"{FOLDER}/{SHORT.get(name, name)}.parquet", columns=list(cols) or None)


def search(x) -> str:
    return re.sub(r"[^a-z0-9]+", " ", str(x or "").lower()).strip()


def text_cluster_report():
    d = table("documents", "doc_id", "doc_year", "source", "text")
    d["cluster"] = [hashlib.sha1((search(x) or f"missing {i}").encode()).hexdigest()[:16] for i, x in zip(d["doc_id"], d["text"])]
    out = []
    for c, g in d.groupby("cluster"):
        if g["doc_id"].nunique() > 1:
            ids = sorted(map(str, g["doc_id"].unique()))
            out.append((c, len(ids), len(g), g.sort_values("doc_id")["source"].dropna().head(1).tolist(), g["doc_year"].min(), g["doc_year"].max(), "|".join(ids[:5])))
    return out


def keep_latest():
    return table("awards", "award_id", "record_id", "last_amendment_date").sort_values(["award_id", "last_amendment_date", "record_id"], ascending=[True, False, True], na_position="last").drop_duplicates("award_id")


def normalize_text():
    return [(re.sub(r"\s+", " ", str(x or "")).strip(), search(x)) for x in table("documents", "text")["text"]]


def lexicon_flags():
    a = table("awards", "title_clean", "abstract_clean")
    flags = {name: re.compile(lexicon_pattern(*lists)) for name, lists in FLAGS.items()}
    return [[bool(f.search(x)) for f in flags.values()] for x in (search(f"{t or ''} {b or ''}") for t, b in zip(a["title_clean"], a["abstract_clean"]))]


def edges_collab():
    e = table("edges", "award_id", "pi_id", "pi_name", "start_year").dropna(subset=["award_id", "pi_id"]).drop_duplicates()
    held = defaultdict(lambda: [set(), []])
    for award, g in e.groupby("award_id"):
        for p, q in combinations(sorted(g.itertuples(index=False), key=lambda r: str(r.pi_id)), 2):
            if p.pi_id != q.pi_id:
                h = held[(p.pi_id, p.pi_name, q.pi_id, q.pi_name)]
                h[0].add(award)
                h[1].append(np.nanmin([p.start_year, q.start_year]) if not (pd.isna(p.start_year) and pd.isna(q.start_year)) else None)
    return held


def prior_counts():
    a = table("awards", "institution_id", "start_year").dropna()
    out = []
    for k, g in a.groupby("institution_id"):
        years = Counter(g["start_year"])
        seen = 0
        for y in sorted(years):
            out.append((k, y, seen))
            seen += years[y]
    return out


def history_features():
    a = table("awards", "award_id", "record_id", "start_year", "person_id", "institution_id", "programelementcodes").sort_values("record_id").drop_duplicates("award_id").dropna(subset=["award_id", "start_year"])
    team = table("edges", "award_id", "person_id").dropna().drop_duplicates().groupby("award_id")["person_id"].apply(list).to_dict()
    count, mates, programs, inst, people = Counter(), defaultdict(set), defaultdict(set), Counter(), defaultdict(set)
    pairs, out = Counter(), []
    for _, g in a.groupby("start_year"):
        rows = [(r.award_id, r.person_id, r.institution_id, (re.split(r"[,;|/\s]+", r.programelementcodes or "") or [""])[0], team.get(r.award_id) or [r.person_id]) for r in g.itertuples(index=False)]
        for award, lead, place, program, members in rows:
            out.append((award, count[lead], len(mates[lead]), len(programs[lead]), inst[place], len(people[place]), sum(count[m] for m in members), sum(pairs[p] for p in combinations(sorted(map(str, members)), 2))))
        for _, lead, place, program, members in rows:
            inst[place] += 1
            for m in members:
                count[m] += 1
                programs[m].add(program)
                people[place].add(m)
                mates[m].update(x for x in members if x != m)
            pairs.update(combinations(sorted(map(str, members)), 2))
    return out


def tfidf():
    a = table("awards", "record_id", "title_clean")
    docs = []
    for x in a["title_clean"]:
        w = [t for t in re.split(r"[^a-z0-9_]+", str(x or "").lower()) if len(t) >= 2]
        docs.append(Counter(w + [f"{p} {q}" for p, q in zip(w, w[1:])]))
    df = Counter(t for d in docs for t in d)
    out = []
    for d in docs:
        v = {t: (1 + np.log(n)) * (np.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in d.items() if df[t] >= 2}
        norm = sum(x * x for x in v.values()) ** 0.5
        out.append({t: x / norm for t, x in v.items()})
    return out


def split_summary():
    b = table("benchmark")
    return [b.groupby([c, "target_mmr_binary"], dropna=False).size() for c in b.columns if c.startswith("split_")]


def p6_ids():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    model.encode_special_tokens = True
    return [model.encode(x or "", add_special_tokens=False).ids for x in table("documents", "text")["text"]]


QUERIES = [text_cluster_report, keep_latest, normalize_text, lexicon_flags, edges_collab, prior_counts, history_features, tfidf, split_summary, p6_ids]


def main() -> None:
    times = {}
    for f in QUERIES:
        began = time.time()
        f()
        times[f.__name__] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds of plain single-machine Python", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": FOLDER}))


if __name__ == "__main__":
    main()
