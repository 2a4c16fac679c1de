from __future__ import annotations

import base64
import hashlib
import random
import re
import string
import time
from collections import Counter
from math import log2

import pytest

from gridloom.llm.secret_scan import CANDIDATE, CLASSES, SHORTEST, SecretScanner, redact


def keys(alphabet: str, n: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(300)]


def test_short_and_letters_only_keys_are_found():
    scan = SecretScanner().scan
    for alphabet in (string.ascii_letters + string.digits + "+/", string.ascii_letters):
        for n in (20, 22, 24, 32):
            assert sum(bool(scan(f"see {k} now")[1]) for k in keys(alphabet, n)) >= 0.9 * 300


def test_of_a_url_only_host_and_path_are_known():
    scan = SecretScanner().scan
    key = "Zk3x9Qp2LmT7vB8nRw4YsD1fGh6J"
    for text in (f"https://a.example.org/x?sig={key}&b=1", f"https://user:{key}@host.org/x"):
        assert key not in redact(text, scan(text)[1])
    for text in (f"https://a.org/{key}", f"https://me@a.org/{key}?a=1", "getUserAccountBalanceInformation", "src/Main/Java/OrgApache/SparkContextFactory"):
        assert scan(text)[1] == []


def brute_entropy(text: str) -> list[tuple[int, int, str]]:
    """Every window of every run counted anew, every span compared with every other."""
    marks: list[tuple[int, int]] = []
    for c in CANDIDATE.finditer(text):
        stretches = []
        for kind in CLASSES:
            for m in re.finditer(f"{kind.chars}{{{min(kind.window, SHORTEST)},}}", c[0]):
                w = min(kind.window, len(m[0]))
                part = lambda x: x * w // kind.window  # noqa: B023, E731
                for i in range(len(m[0]) - w + 1):
                    own = m[0][i : i + w]
                    bits = -sum(n / w * log2(n / w) for n in Counter(own).values())
                    digits, upper, letters = sum(x.isdigit() for x in own), sum(x.isupper() for x in own), sum(x.isalpha() for x in own)
                    mixed = kind.cased and part(kind.cased) <= upper <= letters - part(kind.cased)
                    if bits >= kind.bits * log2(w) / log2(kind.window) - 1e-9 and letters >= part(kind.letters) and (digits >= part(kind.digits) or mixed):
                        stretches.append((c.start() + m.start() + i, c.start() + m.start() + i + w))
        for a, b in sorted(stretches):
            if marks and a <= marks[-1][1] and marks[-1][0] >= c.start():
                marks[-1] = (marks[-1][0], max(b, marks[-1][1]))
            else:
                marks.append((a, b))
    base = SecretScanner().base(text)
    known = [
        r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", r"(?i)\b(?:sha(?:1|224|256|384|512)|md5|integrity|checksum|commit|etag)[-:= ]{1,3}[\"']?(?:[0-9a-f]{128}|[0-9a-f]{96}|[0-9a-f]{64}|[0-9a-f]{56}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9+/=])",
        r"(?i)\bcommit[-:= ]{1,3}[0-9a-f]{7,40}(?![A-Za-z0-9+/=])", r"(?i)\bsha256[-:= ]{1,3}[A-Za-z0-9+/]{43}=(?![A-Za-z0-9+/=])", r"[a-z_.-]*(?:[Ee]xample|[Pp]laceholder|[Cc]hangeme|[Dd]ummy|[Rr]edacted)(?:[a-z_.-]*[0-9]{1,6}(?![A-Za-z0-9+/=])|[a-z_.-]*)",
        r"[A-Z_.-]*(?:EXAMPLE|PLACEHOLDER|CHANGEME|DUMMY|REDACTED)(?:[A-Z_.-]*[0-9]{1,6}(?![A-Za-z0-9+/=])|[A-Z_.-]*)", r"[A-Za-z0-9+/]*EXAMPLE(?:KEY)?(?![A-Za-z0-9+/=_-])", r"x{4,}|X{4,}", r"(?i)[a-z0-9+/]*(?:abcdefghijk|0123456789)[a-z0-9+/]*", r"https?://(?![^\s/?#]*@)[^\s/?#]+(?:/[^\s?#]*)?",
    ]
    inside = [m.span() for p in known for m in re.finditer(p, text)]
    return [(a, b, "entropy") for a, b in marks if not any(x < b and a < y for x, y, _ in base) and not any(x <= a and b <= y for x, y in inside)]


@pytest.mark.parametrize("seed", range(6))
def test_all_spans_equal_brute_force(seed):
    rng = random.Random(seed)
    pieces = [
        lambda: "".join(rng.choice(string.ascii_letters + string.digits + "+/=_-") for _ in range(rng.choice([10, 21, 30, 80, 300]))), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 40]))), lambda: "".join(rng.choice("ABCDEF0123456789") for _ in range(26)),
        lambda: rng.choice(["example", "xxxx", "0123456789", "abcdefghijk", "token=", "AKIA", "sha256:", "https://a.org/", "/", "é漢", "aaaa" * 8]), lambda: "plain words here",
    ]
    text = "".join(rng.choice(pieces)() + rng.choice(["", "", " ", "\n", ","]) for _ in range(160))
    scanner = SecretScanner()
    base, every = scanner.scan(text)
    assert [s for s in every if s[2] == "entropy"] == brute_entropy(text) and [s for s in every if s[2] != "entropy"] == base and any(s[2] == "entropy" for s in every)


@pytest.mark.parametrize("piece", ["", "xxxx", "example ", "0123456789", "token=abcdefgh1 "])
def test_a_very_long_run_takes_linear_time(piece):
    rng = random.Random(1)
    run = "".join(rng.choices(string.ascii_letters + string.digits, k=1_000_000))
    text = piece.join(run[i : i + 100] for i in range(0, len(run), 100)) if piece else run
    began = time.process_time()
    base, every = SecretScanner().scan(text)
    assert time.process_time() - began < 2
    assert piece or not base and sum(b - a for a, b, _ in every) > 0.999 * len(run)


def test_a_key_beside_harmless_words_is_found():
    scan = SecretScanner().scan
    for key in keys(string.ascii_letters + string.digits, 40)[:60]:
        for text in (f"EXAMPLE_KEY={key}", f"s3/example/{key}", f"dummy-{key}", f"commit {key}", f"etag={key}", f"sha256-{key}", f"see {key}"):
            hidden = redact(text, scan(text)[1])
            assert key[4:16] not in hidden and key[24:36] not in hidden, text
        inside = f"{key[:20]}xxxx{key[20:]}"  # nothing of what its windows show is taken back
        assert scan(inside) == SecretScanner(allowed=()).scan(inside)


def test_true_digests_and_placeholders_are_known():
    scan = SecretScanner().scan
    digest = hashlib.sha256(b"x")
    for text in ("commit 3f786850e387", f"sha256-{base64.b64encode(digest.digest()).decode()}", "AbC9xkQ2mPzR7tLwEXAMPLEKEY", "your_dummy_token_placeholder_value_1234", "YOUR_EXAMPLE_API_KEY_GOES_HERE_42", "x" * 40, "123e4567-e89b-12d3-a456-426614174000"):
        assert scan(text)[1] == [], text
    for text in (f"commit {hashlib.sha1(b'x').hexdigest()}", f"etag={hashlib.md5(b'x').hexdigest()}", f"sha256:{digest.hexdigest()}"):
        assert [k for *_, k in scan(text)[1]] == ["hex"], text
