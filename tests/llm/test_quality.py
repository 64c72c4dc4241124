from __future__ import annotations

import random
from collections import Counter

from comparing import DATA, rows, tables
from conftest_llm import ODD, WORDS, frame, prose

from tallyspark.llm import oracles, quality, queries


def measures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_of_odd_texts(odd):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = sorted((tuple(r[c] for c in ["doc_id", *names]) for r in quality.line_rules(odd).collect()), key=str)
    assert found == sorted(((i, *measures(t)) for i, t, _ in ODD), key=str)


def test_many_repeated_windows_are_sorted_not_looked_up(spark):
    text = prose(1, 400) + "\n" + prose(1, 400) + "\n" + prose(2, 100)
    found = quality.line_rules(frame(spark, [(1, text, "a")])).first()
    assert found.n_repeat_words == measures(text)[4] > 700


def test_boilerplate_is_cut_and_depleted_documents_go(spark):
    header = prose(77, 70).replace("\n", " ")
    docs = [(i, f"{header} {i}\n{prose(i, 200)}", "a") for i in range(60)]
    docs += [(100 + i, f"{header} {i}\n{prose(500 + i, 15)}", "a") for i in range(5)]
    docs += [(200 + i, prose(9, 200), "b") for i in range(40)]  # copies are one text
    docs += [(300 + i, "\n".join(x for j, x in enumerate(prose(10, 300).split("\n")) if j != i % 30) + f"\nown {i} {prose(700 + i, 8)}", "b") for i in range(60)]  # near copies are no boilerplate
    judged = {r.doc_id: r for r in quality.line_rules(frame(spark, docs), min_docs=20, max_share=0.05).collect()}
    assert all(len(judged[i].removed) == 1 and judged[i].kept for i in range(60))
    assert all(not judged[100 + i].kept and not judged[100 + i].base_failed for i in range(5))
    assert all(judged[i].kept and not judged[i].removed for i in (*range(200, 240), *range(300, 360)))
    kept = {r.doc_id: r for r in quality.cleaned(frame(spark, docs), min_docs=20, max_share=0.05).collect()}
    assert set(kept) == {i for i, r in judged.items() if r.kept} and kept[3].text == prose(3, 200) and kept[3].n_chars == len(prose(3, 200)) and kept[210].text == prose(9, 200)


def test_hosts_with_several_shared_and_few_own_lines(spark):
    shapes = [(3, 1), (4, 1), (8, 3), (10, 2), (10, 4)]
    docs = []
    for shared, own in shapes:
        shell = prose(40 + shared + own, 10 * shared)
        docs += [(1000 * shared + 100 * own + i, f"{shell}\n{prose(5000 + 1000 * shared + 100 * own + i, 10 * own)}", f"{shared}+{own}") for i in range(60)]
    draw = random.Random(3)  # near copies with one word changed in every sixth line or so
    changed = [[" ".join([f"{draw.choice(WORDS)}{draw.choice(WORDS)}", *x.split()[1:]]) if draw.random() < 1 / 6 else x for x in prose(11, 300).split("\n")] for _ in range(60)]
    docs += [(90_000 + i, "\n".join(x), "edited") for i, x in enumerate(changed)]
    found = {r.doc_id: r for r in quality.line_rules(frame(spark, docs)).collect()}
    for i, _, host in docs:
        assert len(found[i].removed) == (0 if host == "edited" else int(host.split("+")[0])), (host, i)
    assert all(found[90_000 + i].kept for i in range(60)) and not any(found[3100 + i].kept for i in range(60))


def test_empty_table_and_columns(none, odd):
    assert quality.line_rules(none).count() == 0
    assert quality.cleaned(none).columns == none.columns
    assert quality.cleaned(odd).columns == odd.columns


def test_query_equals_sql(spark):
    found = queries.op3_line_rules(spark, str(DATA / "sf0.001")).toPandas()
    assert rows(found) == rows(tables("sf0.001").execute(oracles.SQL["op3_line_rules"]).df())


def test_no_python_in_the_plan(spark):
    plan = queries.op3_line_rules(spark, str(DATA / "sf0.001"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def families() -> list[tuple]:
    """Boilerplate over own lines, shells with few own lines, families of near copies, copies, and keys that differ in digits alone."""
    header = prose(77, 70).replace("\n", " ")
    docs = [(i, f"{header} {i}\n{prose(i, 200)}", "a") for i in range(60)]
    docs += [(100 + i, f"{header} {i}\n\n{prose(500 + i, 15)}\npage {i}\npage {i + 1}", "a") for i in range(5)]
    docs += [(200 + i, prose(9, 200), "b") for i in range(40)]
    docs += [(300 + i, "\n".join(x for j, x in enumerate(prose(10, 300).split("\n")) if j != i % 30) + f"\nown {i} {prose(700 + i, 8)}", "b") for i in range(60)]
    for shared, own in ((3, 1), (10, 1), (10, 2), (20, 1)):
        shell = prose(40 + shared + own, 10 * shared)
        docs += [(1000 * shared + 100 * own + i, f"{shell}\n{prose(5000 + 1000 * shared + 100 * own + i, 10 * own)}", f"{shared}+{own}") for i in range(60)]
    return docs


def test_sql_states_the_rule_where_it_decides(spark):
    docs = frame(spark, families())
    duck = tables("sf0.001")
    duck.execute("DROP VIEW documents")
    duck.register("documents", docs.select("doc_id", "text", "source").toPandas())
    found = quality.line_rules(docs)
    judged = {r.doc_id: r for r in found.collect()}
    named = {r[0]: r for r in duck.execute(f"SELECT doc_id, kept, left_share, n_removed_lines FROM ({oracles.SQL['op3_line_rules']})").fetchall()}
    assert set(judged) == set(named)
    assert all((r.kept, round(r.left_share, 6), len(r.removed)) == named[i][1:] for i, r in judged.items())
    removed = {s: sum(len(judged[i].removed) for i, _, h in families() if h == s) for s in ("a", "b", "3+1", "10+1", "10+2", "20+1")}
    assert removed["a"] and removed["3+1"] and removed["10+2"] and not removed["b"] and not removed["10+1"] and not removed["20+1"]


def test_long_document_with_shared_lines(spark):
    import time

    shared = [f"shared {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} line of all" for i in range(400)]
    spell = str.maketrans("0123456789", "abcdefghij")
    docs = [(i, "\n".join([shared[i % 400], *(shared[:60]), prose(i, 400)]), "a") for i in range(60)]
    docs.append((999, "\n".join(f"{shared[i % 60]}\nown {str(i).translate(spell)} words of it" for i in range(100_000)), "a"))
    began = time.perf_counter()
    kept = {r.doc_id: r.text for r in quality.cleaned(frame(spark, docs), max_repeat_share=101).collect()}
    assert time.perf_counter() - began < 90
    assert kept[999] == "\n".join(f"own {str(i).translate(spell)} words of it" for i in range(100_000))
