import hashlib
import ipaddress
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tendril.llm import pii

KEY = b"test"
SCHEMA = "doc_id long, text string, kind string, entity string, spans string"


def one(text, key=KEY):
    """A text with surrogates, by the scan and the surrogates alone."""
    out, at = "", 0
    for k, a, b in pii.scan(text):
        out += text[at:a] + pii._put(k, text[a:b], pii.surrogate(k, pii.entity_of(k, text[a:b]), key))
        at = b
    return out + text[at:]


@settings(max_examples=50, deadline=None)
@given(st.integers(2, 3000), st.text("abc", max_size=3))
def test_permutations_are_one_to_one(size, label):
    assert sorted(pii.permute(KEY, label, n, size) for n in range(min(size, 300))) == sorted(set(pii.permute(KEY, label, n, size) for n in range(min(size, 300))))
    if size <= 300:
        assert sorted(pii.permute(KEY, label, n, size) for n in range(size)) == list(range(size))


def plain_numbers(t):
    """Every number by one pattern over the whole text, without the runs."""
    return [(m.lastgroup, m.start(), m.end()) for m in re.finditer("|".join(f"(?P<{k}>{p})" for k, p in pii.NUMBERS.items()), t)]


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789 .()-+a", max_size=60))
def test_runs_hide_no_number(text):
    assert [s for s in pii.scan(text) if s[0] in pii.NUMBERS] == plain_numbers(text)


def test_formats_genders_and_scripts():
    text = "mail Bob.Lee@Mail.example.com or bob.lee@mail.example.com, 10.1.2.3, card 4111 1111 1111 1111 and 4111-1111-1111-1111, 123-45-6789, +1 (555) 123-4567 and +1 555-123-4567."
    out = one(text)
    assert re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "0", out)))[:20] == re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "0", text)))[:20]
    a, b = re.findall(r"\S+@\S+[a-z]", out)
    assert a.lower() == b and a != b and b != "bob.lee@mail.example.com"
    c = re.findall(r"card (.{19}) and (.{19}),", out)[0]
    assert c[0].replace(" ", "") == c[1].replace("-", "") and c[0] != "4111 1111 1111 1111" and pii.luhn(c[0].replace(" ", ""))
    p = re.findall(r"\+.*?\d{3}-\d{4}", out)
    assert re.sub(r"\D", "", p[0]) == re.sub(r"\D", "", p[1]) and re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", p[0])
    assert re.search(r"\d{3}-\d{2}-\d{4}", out) and "123-45-6789" not in out


def test_mentions_of_one_person_stay_one():
    out = one("Mr. Adam Smith came. Later Adam Smith left; Mr. Smith, SMITH? Smith said so, unlike Smithson. Mrs. Anna Smith and Dr Who; Herr Müller. Müller!")
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Later (\w+) (\w+) left; Mr\. (\w+), SMITH\? (\w+) said so, unlike Smithson\. Mrs\. (\w+) (\w+) and Dr Who; Herr (\w+)\. (\w+)!", out)
    g = m.groups()
    assert g[0] == g[2] and g[0] in pii.GIVEN["m", "latin"] and g[1] == g[3] == g[4] == g[5] == g[7] and g[1] != "Smith" and len(g[1]) == 5
    assert g[6] in pii.GIVEN["f", "latin"] and g[8] == g[9] != "Müller" and g[8][1] in "àáâãäåèéêëìíîïòóôõöùúûü" and g[8][0] in "BCDFGHJKLMNPQRSTVWXYZ"
    assert one("Госпожа Анна Иванова") != "Госпожа Анна Иванова" and one("Госпожа Анна Иванова").split()[1] in pii.GIVEN["f", "cyrillic"]
    assert one("The Der Mr. is. Herr der. Adam. Smith and Frau 7") == "The Der Mr. is. Herr der. Adam. Smith and Frau 7"


def test_surrogates_are_distinct_within_a_kind():
    given = [n.lower() for names in pii.GIVEN.values() for n in names] + ["bob", "tom", "tim", "jon", "leo", "zoe", "eva", "eve"]
    made = [pii.surrogate("given", e, KEY) for e in dict.fromkeys(given)]
    assert len(set(made)) == len(made)
    cards = [f"4{i:015d}" for i in range(300)]
    assert len({pii.surrogate("card", c, KEY) for c in cards}) == 300


WORDS = st.text(st.characters(min_codepoint=97, max_codepoint=0x4FF, categories=("Ll", "Lo")), min_size=1, max_size=8)
DIGITS = st.text("0123456789", min_size=9, max_size=9)
ENTITIES = st.one_of(
    st.tuples(st.sampled_from(["given", "family"]), WORDS.filter(lambda w: any(pii._class(c) for c in w))),
    st.tuples(st.just("email"), st.builds("{}@{}.org".format, st.text("abcö.", min_size=1, max_size=6), st.text("abcü", min_size=1, max_size=4))).filter(lambda e: e[1][0] != "."),
    st.tuples(st.just("ip"), st.ip_addresses(v=4).map(str)),
    st.tuples(st.just("ip6"), st.ip_addresses(v=6).filter(lambda a: int(a) % (1 << 96)).map(str)),
    st.tuples(st.just("ssn"), DIGITS),
    st.tuples(st.just("card"), DIGITS.map("4242424".__add__)),
    st.tuples(st.just("phone"), st.tuples(st.sampled_from(["+1", "+49", "+420", ""]), DIGITS).map("".join)),
    st.tuples(st.just("iban"), DIGITS.map(lambda d: "DE" + pii.iban_check("DE", d * 2) + d * 2)),
)


@settings(max_examples=400, deadline=None)
@given(ENTITIES, st.binary(max_size=80))
def test_no_entity_is_its_own_surrogate(entity, key):
    kind, e = entity
    made = pii.surrogate(kind, e, key)
    assert made != e and len(made) == len(e) or kind in ("ip", "ip6", "given")
    assert made != e and pii.entity_of(kind, made) == made


def test_no_listed_name_is_its_own_surrogate():
    for key in (b"", b"a", b"b", b"tendril", bytes(100)):
        for names in pii.GIVEN.values():
            made = [pii.surrogate("given", n.lower(), key) for n in names]
            assert sorted(made) == sorted(n.lower() for n in names) and not any(m == n.lower() for m, n in zip(made, names, strict=True))


def test_every_letter_moves_within_its_script():
    assert all(pii.surrogate("family", c, KEY) not in (c, "") for c in "óёøßñçλωжъіїćđžшąא漢")
    for e in ("ёё", "øå", "müller", "λάμδα", "јовић"):
        made = pii.surrogate("family", e, KEY)
        assert made != e and len(made) == len(e) and [ord(c) // 128 for c in made] == [ord(c) // 128 for c in e]
    whole = sorted(pii.surrogate("family", a + b, KEY) for a in "аеёиоуыэюя" for b in "ъь")
    assert whole == sorted(a + b for a in "аеёиоуыэюя" for b in "ъь")


def test_a_cycle_walks_whole_classes():
    even = [n for n in range(200) if n % 2 == 0]
    made = [pii.move(KEY, "x", n, 200, lambda m: m % 2 == 0) for n in even]
    assert sorted(made) == even and not any(a == b for a, b in zip(made, even, strict=True))
    assert pii.move(KEY, "x", 7, 200, lambda m: m == 7) == 7 and pii.move(KEY, "x", 0, 1) == 0
    assert all(pii.unpermute(KEY, "y", pii.permute(KEY, "y", n, 777), 777) == n for n in range(777))


def test_surrogates_keep_their_type():
    inside = lambda a, net: ipaddress.ip_address(a) in ipaddress.ip_network(net)
    for net in ("10.0.0.0/8", "192.168.0.0/16", "127.0.0.0/8", "203.0.113.0/24"):
        hosts = [str(ipaddress.ip_network(net)[i]) for i in range(200)]
        made = [pii.surrogate("ip", h, KEY) for h in hosts]
        assert len(set(made)) == 200 and all(inside(m, net) for m in made)
    assert all(ipaddress.ip_address(pii.surrogate("ip", f"8.8.{i}.8", KEY)).is_global for i in range(50))
    assert pii.surrogate("ip6", "fe80::1:2", KEY).startswith("fe80::") and inside(pii.surrogate("ip6", "2001:db8::77", KEY), "2001:db8::/32")
    assert inside(pii.surrogate("ip6", "2a00:1450::5", KEY), "2000::/3") and pii.surrogate("ip6", "::1", KEY) != ""
    assert pii.surrogate("phone", "+4930123456", KEY).startswith("+49") and pii.surrogate("phone", "+420601123456", KEY).startswith("+420")
    for i in range(50):
        d = pii.surrogate("phone", f"+1555234{i:04d}", KEY)
        assert d[:2] == "+1" and d[2] >= "2" and d[5] >= "2"
        assert pii._ssn(pii.surrogate("ssn", f"12345{i + 1:04d}", KEY)) and not pii._ssn(pii.surrogate("ssn", f"00000{i:04d}", KEY))
        account = f"3704004405320130{i:02d}"
        iban = pii.surrogate("iban", "DE" + pii.iban_check("DE", account) + account, KEY)
        assert iban[:2] == "DE" and pii._is_iban(iban) and iban[4:] != account


def test_more_mentions_are_found():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in pii.scan(t)]
    assert kinds("jörg@firma.de, x@müller.de") == [("email", "jörg@firma.de"), ("email", "x@müller.de")]
    assert kinds("Contact John Smith or Priya Patel") == [("given", "John"), ("family", "Smith"), ("given", "Priya"), ("family", "Patel")]
    assert kinds("Dr. John Smith, Prof. Jones and Dr Xenia Quist") == [("given", "John"), ("family", "Smith"), ("family", "Jones"), ("given", "Xenia"), ("family", "Quist")]
    assert kinds("at 2001:DB8::8a2e:0370:7334, fe80:0:0:0:1:2:3:4") == [("ip6", "2001:DB8::8a2e:0370:7334"), ("ip6", "fe80:0:0:0:1:2:3:4")]
    assert kinds("std::vector a::b 12:30:45 face::bad::c0ffeeg :: ::1 0:1") == []
    assert kinds("pay DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432") == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    out = one("2001:db8:85a3:0:0:8a2e:370:7334 is 2001:0DB8:85A3::8A2E:0370:7334; DE89 3704 0044 0532 0130 00 is DE89370400440532013000.")
    a, b, c, d = re.fullmatch(r"(\S+) is (\S+); (.+) is (\S+)\.", out).groups()
    assert ipaddress.ip_address(a) == ipaddress.ip_address(b) and b.startswith("2001:0DB8:") and b == b.upper() and "::" in b and pii._is_ip6(a)
    assert c.replace(" ", "") == d and [len(g) for g in c.split(" ")] == [4, 4, 4, 4, 4, 2] and pii._is_iban(d)
    assert one("call 1-555-234-5678")[5:] == one("call +1 555 234 5678")[6:].replace(" ", "-")


def test_replace_matches_plain_and_checks_collisions(spark):
    long = "x y z " * 30_000 + "call 555-123-4567"
    rows = [(1, None, "a", "b", "c"), (2, "", "a", "b", "c"), (3, "a.b@c.org", "a", "b", "c"), (3, "a.b@c.org", "a", "b", "c"), (None, "10.0.0.1", None, None, None), (4, long, "a", "b", "c"), (5, "Mr. Smith", "", "", ""), (6, "Frau Eva Smith é", "", "", "")]
    got = pii.replace(spark.createDataFrame(rows, SCHEMA), KEY).collect()
    want = [(d, one(t or "")) for d, t, *_ in rows]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)
    assert all(r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.n_entities == len([s for s in r.spans.split(",") if s]) for r in got)
    assert pii.replace(spark.createDataFrame([], SCHEMA), KEY).collect() == []
    same = spark.createDataFrame([("ssn", "123456789"), ("ssn", "123456789")], "kind string, entity string")
    assert pii.collisions(same, KEY).count() == 1 and pii.collisions(same.distinct(), KEY).count() == 0
