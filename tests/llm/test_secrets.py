import random
import re

from ledgerloom.llm.secrets import DEFAULT_RULES, digest, mask_secrets, scanner, secret_report

#: The rules as Python's regex engine states them, with what a match must hold.
EDGE = r"(?<![A-Za-z0-9_])"
WORDS = {"bearer": EDGE + r"bearer[\t-\r\x20]+[A-Za-z0-9._~+/=-]{20,}", "service": EDGE + r"sk-[A-Za-z0-9_-]+"}
PLAIN = [(re.compile(WORDS.get(r.kind, r.pattern.decode().replace("{6,}", "+")), re.A | (re.I if r.ignore_case else 0)), r) for r in DEFAULT_RULES]
PARTS = ["password", "Token", "api_key", "apikey", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "é", "ghp_", "a" * 36, "AIza", "x", "-----BEGIN RSA PRIVATE KEY-----", "z9", "\n", "/", "漢", "Bearer ", "bearer\n", "sk-", "sk-" + "k" * 20, "eyJ" + "h" * 18, "MIIE+/==", "DEK-Info: A,B", "\\n", "-----END RSA PRIVATE KEY-----"]


def brute(text):
    found = []
    for n, (pattern, rule) in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            if len(m[0]) >= rule.least and (not rule.least_value or len(m[2]) >= 6):
                found.append((m.start(), m.end(), n))
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_automaton_equals_regex():
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert scanner(DEFAULT_RULES).spans(text) == brute(text), text


def test_report_and_mask(spark):
    rows = [(1, "token = 'abcdef' é", "x"), (1, "token = 'abcdef' é", "x"), (2, None, "y"), (3, "", "z"), (None, "é AKIA" + "A" * 16, None), (4, "x" * 200_000 + " password:abc", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, secrets string")
    got = sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_report(docs).collect())
    want = []
    for i, text, _ in rows:
        spans = [(DEFAULT_RULES[n].kind, s, e) for s, e, n in brute(text)]
        counts = [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")]
        want.append((i or 0, *counts, digest([x for x in spans if x[0] in ("assign", "access", "hex")]), ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
    assert got == sorted(want)
    masked = {r.doc_id: r.text for r in mask_secrets(docs).collect()}
    assert masked[1] == "[SECRET]' é" and masked[2] is None and masked[3] == "" and masked[None] == "é [SECRET]"
    assert secret_report(docs.limit(0)).count() == 0


def test_whole_keys_and_tokens_are_masked(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB12\n\nMIIEpAIB+/aa\nbbbb==\n-----END RSA PRIVATE KEY-----"
    token, other = "sk-" + "aB3_-" * 5, "eyJhbGciOi.JIUzI1-NiJ9=="
    texts = [f"a {key} b", f"a {key} b".replace("\n", "\\n"), f"a {key} b".replace("\n", " \r\n  "), f"x {token} y", f"bearer \n {other} y", f"ri{token} ri-{token}", "Bearer of news, sk-short"]
    got = [r.text for r in mask_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)).orderBy("doc_id").collect()]
    assert all(x.replace("[SECRET]", "") == "a  b" for x in got[:3]), got
    assert got[3:] == ["x [SECRET] y", "[SECRET] y", f"ri{token} ri-[SECRET]", texts[6]]
