from __future__ import annotations

import re

from comparing import DATA
from conftest_llm import ODD, frame, prose

from tallyspark.llm import privacy, queries
from tallyspark.llm.common import table

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text: str) -> list[tuple[int, int, int]]:
    """The base rules word for word."""

    def holds(kind: int, match: str) -> bool:
        digits = re.sub("[^0-9]", "", match)
        if kind == 1:
            return all(int(p) <= 255 for p in match.split("."))
        return kind == 0 or (14 <= len(digits) <= 19 and privacy.luhn(digits) if kind == 2 else 10 <= len(digits) <= 15)

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if holds(k, m[0]))


TRICKY = [
    "a@b.co_x@y.zz q@@w.e.r a.@b-.c- @x.y u@v", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 4273733944729324 44.144.126.223 +1 (906) 555-7738",
    "++1 23 4567 8901 2 +1 (((2))) +12345678901234567890 + 1234567890 +1-2-3-4-5-6-7-8-9-0-", "x" * 300 + "@" + "y" * 300, "0" * 40 + " 4" + "0" * 15, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "é+1 906 555 7738ß 😀a@b.c\n",
]


def test_base_spans_follow_the_rules():
    for text in TRICKY:
        assert privacy.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    import time

    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" + " " * 300_000, "1." * 150_000, "1 " * 150_000 + "x"):
        privacy.base_spans(text)
        privacy.occurrences(text[:60_000], [])
    assert time.time() - began < 30


def test_query_on_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, str(DATA / "sf0.001"), "documents").collect()}
    for r in queries.op2_contextual_pii(spark, str(DATA / "sf0.001")).collect():
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        said = ",".join(f"{privacy.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == __import__("hashlib").sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_context_finds_unseen_identifiers(spark):
    docs = [(i, f"{prose(i, 20)}\nplease ring hotline {f'+1 (906) 555-{7000 + i}' if i < 30 else f'906-555-{7000 + i}'} now\n{prose(900 + i, 20)}", "a") for i in range(34)]
    docs += [(100 + i, f"{prose(i, 20)}\nlot number 906-555-{8000 + i} sold", "a") for i in range(9)]
    found = {r.doc_id: r for r in privacy.personal_data(frame(spark, docs)).collect()}
    assert all(len(found[i].all_spans) == 1 and privacy.KINDS[found[i].all_spans[0].k] == "phone" for i in range(34))
    assert all(not found[i].base for i in range(30, 34)) and all(not found[100 + i].all_spans for i in range(9))
    hidden = {r.doc_id: r.text for r in privacy.redacted(frame(spark, docs)).collect()}
    assert "hotline [PHONE] now" in hidden[2] and "hotline [PHONE] now" in hidden[32] and "906-555-8001" in hidden[101]


def test_unseen_identifiers_may_outnumber_the_seeds(spark):
    words = ["ring hotline", "call hotline", "dial hotline"]
    docs = [(i, f"please {words[i % 3]} {f'+1 (906) 555-{1000 + i}' if i < 100 else f'906-555-{1000 + i}'} now", "a") for i in range(400)]
    docs += [(1000 + i, f"by index {f'+1 (907) 555-{1000 + i}' if i < 10 else f'907-555-{1000 + i}'} sold", "a") for i in range(400)]  # too small a share of seeds
    docs += [(2000 + i, f"at desk {f'+1 (908) 555-{1000 + i}' if i < 40 else f'10.1.2.{i}' if i < 80 else f'908-555-{1000 + i}'} open", "a") for i in range(200)]  # as many seeds of another kind
    found = {r.doc_id: r for r in privacy.personal_data(frame(spark, docs)).collect()}
    assert all([privacy.KINDS[x.k] for x in found[i].all_spans] == ["phone"] for i in range(400))
    assert not any(found[i].all_spans for i in (*range(1010, 1400), *range(2080, 2200)))


def test_odd_rows(odd, none):
    found = privacy.personal_data(odd).collect()
    assert len(found) == len(ODD)
    assert privacy.redacted(odd).columns == odd.columns and privacy.redacted(odd).count() == len(ODD)
    assert privacy.personal_data(none).count() == 0 and privacy.redacted(none).count() == 0


def test_long_octets_and_lists_of_numbers():
    import time

    assert privacy.base_spans("0" * 6000 + ".1.1.1 x") == [(0, 1, 6006)] and privacy.base_spans("1" * 6000 + ".1.1.1") == []
    began = time.time()
    assert len(privacy.occurrences("call +1 (906) 555-7738 or 906-555-7738, " * 20_000, [])) > 20_000
    privacy.occurrences(" at a" * 200_000, [])
    assert time.time() - began < 30


def test_contexts_hold_whole_words():
    long = "w" * 300
    text = f"{long} x\ny {long} 906-555-7738 {long}z\n"
    at = text.index("906")
    assert privacy.Contexts(text).of(at, at + 12) == [f"y {long} _", f"{long} _", f"_ {long}z"]


def test_obfuscated_addresses_and_secrets(spark):
    docs = [(i, f"{prose(i, 20)}\nplease write mailto {f'a{i}@example.com' if i < 20 else f'jane{i} [AT] example [DOT] com' if i < 25 else f'jane{i}(at)example.com'} soon", "a") for i in range(30)]
    docs += [(100 + i, f"{prose(i, 20)}\napikey = {chr(34) + f'{i:02d}' + 'ab3' * 12 + chr(34) if i < 12 else f'zz{i}' + 'Q7x' * 9} end", "a") for i in range(16)]
    found = {r.doc_id: [privacy.ALL_KINDS[x.k] for x in r.all_spans] for r in privacy.personal_data(frame(spark, docs)).collect()}
    assert all(found[i] == ["email"] for i in range(30)) and all(found[100 + i] == ["secret"] for i in range(16))


def test_extra_spans_of_the_tables(spark):
    """What context adds on the tables are the quoted tokens, told apart by a plain expression over every text."""
    sf = str(DATA / "sf0.01")
    found = {r.doc_id: r.spans for r in queries.op2_contextual_pii(spark, sf).collect()}
    said = 0
    for r in table(spark, sf, "documents").collect():
        expected = [f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)\btoken = "([0-9a-f]{40})"', r.text or "")]
        assert [x for x in found[r.doc_id].split(",") if x.startswith("secret")] == expected
        said += len(expected)
    assert said > 5
