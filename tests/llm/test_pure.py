"""Parts of the operators without Spark, against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import regex

from cloakframe.llm import chat, html, langid, licenses, matroska, secrets, simhash, tokens
from cloakframe.llm.decontaminate import align
from cloakframe.llm.common import words


# --- secrets ------------------------------------------------------------------------------------------


def brute_secrets(texts, rules):
    return sorted((i, name, m.start(), m.end()) for i, t in enumerate(texts) for name, p in rules for m in re.compile(p, re.ASCII).finditer(t or ""))


def redacted(text):
    found = secrets.scanner(secrets.RULES).scan(pa.array([text]))
    return secrets._without(text, sorted((a, b) for _, _, a, b in found))


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\\n"])
@pytest.mark.parametrize("end", [True, False])
@pytest.mark.parametrize("fields", ["", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"])
def test_no_key_body_is_left(newline, end, fields):
    rng = random.Random(4)
    body = ["".join(rng.choice("ABCDEFGHabcdefgh0123+/") for _ in range(n)) for n in (64, 64, 64, 20)] + ["Zz9="]
    key = ("-----BEGIN RSA PRIVATE KEY-----\n" + fields + "\n".join(body) + ("\n-----END RSA PRIVATE KEY-----" if end else "")).replace("\n", newline)
    assert redacted(f"before {key}\n\n- after it. {key}\n\n(end)") == "before [SECRET]\n\n- after it. [SECRET]\n\n(end)"


@pytest.mark.parametrize("secret", [
    "eyJ" + "a" * 700 + ".eyJ" + "b" * 2000 + "." + "c" * 900, "password=" + "d" * 300, "xoxb-" + "1" * 300, "sk_live_" + "9" * 300,
    "https://" + "u" * 150 + ":" + "p" * 150 + "@" + "h" * 250 + ".org", "elasticsearch://user:pw12@host",
])
def test_long_secrets_are_whole(secret):
    assert redacted(f"a {secret} z") == "a [SECRET] z"


def test_secret_scan_equals_a_full_scan():
    rng = random.Random(1)
    planted = ["AKIA" + "A1" * 8, "ghp_" + "x" * 36, "PASSWORD = 'abcdefghijkl0'", "a" * 39 + "b", "-----BEGIN RSA PRIVATE KEY-----", "sk_live_" + "9" * 20, "https://u:pw12@h.org", "xoxb-" + "1" * 12, "AIza" + "_" * 35, "Token: é" + "z" * 12]
    noise = ["é", "ghp", "AKI", "password", " ", "\n", "key", "-----BEGIN"]
    texts = ["".join(rng.choice(planted + noise * 3) + rng.choice([" ", "", "é "]) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "ab"]
    rules = [*secrets.RULES, ("anything", r"[0-9]{2}é?"), ("two", r"(?:abc|xyz)+d|q{3}")]
    assert sorted(secrets.scanner(rules).scan(pa.array(texts, pa.string()))) == brute_secrets(texts, rules)


@pytest.mark.parametrize("pattern,text", [(r"abc+d", "xabccdx"), (r"(?i)PassWord", "pAsSwOrD"), (r"a(?:bc|de){2}f", "abcdef"), (r"x?yz[0-9]k", "yz7k"), (r"\bfoo.{0,5}bar", "foo--bar"), (r"[ab][cd][ef]", "bde")])
def test_every_match_meets_its_trigram_query(pattern, text):
    data = text.lower().encode()
    have = {data[i : i + 3] for i in range(len(data) - 2)}

    def holds(q):
        return q is True or (q[0] == "tri" and q[1] in have) or (q[0] == "and" and all(map(holds, q[1]))) or (q[0] == "or" and any(map(holds, q[1])))

    assert re.search(pattern, text) and holds(secrets.trigram_query(pattern))


def test_rules_without_trigrams_ask_for_nothing():
    assert secrets.trigram_query(r"[0-9]{16}") is True and secrets.trigram_query(r"ab|c") is True


def test_sql_of_all_rules_gives_the_same_spans():
    import duckdb

    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join("Ab0+" * 16 for _ in range(5)) + "\nZz9=\n"
    texts = [
        "x " + key + "-----END RSA PRIVATE KEY----- y " + key + "\n(no end)", "eyJ" + "a" * 700 + ".eyJ" + "b" * 900 + "." + "c" * 600 + ";", "password = '" + "d" * 300 + "' AKIA" + "Z9" * 8,
        "ghp_" + "q" * 36 + " AIza" + "-" * 35 + "\n" + "0a" * 20, "xoxb-" + "1" * 250 + " sk_live_" + "9" * 300, "postgres://" + "u" * 120 + ":" + "p" * 120 + "@" + "h" * 220 + ".org z", "nothing", "",
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = secrets.scanner(secrets.RULES).scan(pa.array(texts))
    assert sorted(con.execute(secrets.OP1_SQL).fetchall()) == sorted(got) and {x[1] for x in got} == {name for name, _ in secrets.RULES}


# --- html ---------------------------------------------------------------------------------------------


def test_field_is_accurate_on_pages_it_has_not_seen():
    pages, labels = html.labelled_pages(150, 99)
    found = html.default_field().viterbi([html.features(html.blocks(p)) for p in pages])
    y, x = np.concatenate(labels), np.concatenate(found)
    assert (y == x).mean() > 0.97


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(0)
    n = len(html.FEATURES)
    field = html.Field(rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), rng.normal(size=(2, 2)))
    for size in (1, 2, 5, 8):
        page = [sorted(rng.choice(n, 4, replace=False).tolist()) for _ in range(size)]

        def score(y):
            s = field.ends[0][y[0]] + field.ends[1][y[-1]] + sum(field.weights[f, l] for fs, l in zip(page, y) for f in fs)
            return s + sum(field.moves[a, b] for a, b in zip(y, y[1:]))

        best = max(([k >> i & 1 for i in range(size)] for k in range(1 << size)), key=score)
        assert field.viterbi([page])[0].tolist() == best


def test_broken_html_is_read_as_far_as_it_goes():
    for page in ("", "<", "<p", "<p>a<p>b</div></p>", "text &amp; more", "<!-- open", "<script>x", "<ul><li>a<li>b", "<a href='x>y'>z</a>" * 50):
        html.blocks(page)
    assert [b[4] for b in html.blocks("<p>a &amp; b<p>c<br>d")] == ["a & b", "c d"]
    assert [b[4] for b in html.blocks("<p title='a>b' x=\"c>d\">e</p><p x='>f<p>g>h")] == ["e", "f", "g>h"]


@pytest.mark.parametrize("page", ["<div>x" * 20_000, "<a '" * 50_000, "<a ='" * 50_000 + '=">"', "<script" * 50_000, "<" * 200_000, "<div>" * 30_000 + "</p>" * 30_000, "<p " * 50_000 + ">", "<!--" * 50_000, "<a =" * 50_000 + "'>"])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.features(html.blocks(page))
    assert time.process_time() - began < 10


def test_field_is_accurate_on_given_pages():
    """Labels by hand: what the pages' <article> holds is main text, the rest isn't."""
    import pyarrow.parquet as pq

    pages = [html.blocks(p) for p in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist() if p]
    y = np.array(["article" in b[2] for p in pages for b in p])
    x = np.concatenate(html.default_field().viterbi([html.features(p) for p in pages])).astype(bool)
    assert 0.1 < y.mean() < 0.95 and (y == x).mean() > 0.95


# --- chat ---------------------------------------------------------------------------------------------


def test_chat_round_trip_of_hostile_turns():
    rng = random.Random(2)
    bits = ["<|", "|>", "end", "<|end|>", "\n", "\\", "<|user|0|>\n", "a", "\n<|end|>\n", "\\<|end|>", "é"]
    for _ in range(600):
        turns = [(rng.choice(chat.ROLES), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
        text, escaped, _ = chat.round_trip(turns)
        assert chat.parse(text) == turns
        assert escaped == sum(chat.parse(chat.render([t], [0])) != [t] for t in turns)


def test_texts_that_are_no_chat():
    for text in ("x", "<|user|0|>\n", "<|nobody|0|>\na\n<|end|>\n", "<|user|x|>\na\n<|end|>\n"):
        assert chat.parse(text) is None


# --- matroska -----------------------------------------------------------------------------------------


def test_packets_give_the_frames_back():
    rng = random.Random(3)
    for n in (1, 3, 4, 16, 17, 100):
        frames = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 254, 255, 256, 700]))) for _ in range(n)]
        media = matroska.write(frames)
        packets = matroska.Parser(media).parse()
        assert [media[p[5] : p[5] + p[6]] for p in packets] == frames
        assert [p[2] for p in packets] == [i * 1_000_000_000 for i in range(n)]
        assert all(p[7] == (i % 16 < (1 if i // 16 % 4 == 0 else 4)) for i, p in enumerate(packets))


def test_damaged_media_gives_what_stands_before_the_damage():
    frames = [b"abc%d" % i * 9 for i in range(40)]
    media = matroska.write(frames)
    whole = matroska.Parser(media).parse()
    for cut in range(0, len(media), 37):
        got = matroska.Parser(media[:cut]).parse()
        assert [p[:7] for p in got] == [p[:7] for p in whole[: len(got)]]
    assert matroska.Parser(b"").parse() == [] and matroska.Parser(b"RIFF....").parse() == []


def test_a_file_written_by_hand():
    """Bytes after the public specification: EBML head, segment of unknown size, info, one track, a cluster with all lacings."""
    hexa = lambda x: bytes.fromhex(x.replace(" ", ""))
    head = hexa("1A45DFA3 84 4282 81 78")
    info = hexa("1549A966 87 2AD7B1 83 0F4240")  # time scale: 1,000,000 ns
    track = hexa("1654AE6B 94 AE 92 D7 81 05 83 81 11 86 85") + b"S_ABC" + hexa("23E383 81 64")  # number 5, 100 ns a frame
    blocks = [
        hexa("A3 86 85 0001 80") + b"ab",  # no lacing, at 0x03E8 + 1 ms, keyframe
        hexa("A3 8C 85 0002 02 02 01 02") + b"xyyzz",  # Xiph: 1, 2 and the rest
        hexa("A3 89 85 0003 84 01") + b"ppqq",  # fixed: two of two bytes
        hexa("A3 90 85 FFFF 06 02 81 C0") + b"abb" + b"tail12",  # EBML: 1, then 1 more, the rest; 1 ms before
        hexa("A0 8A A1 85 85 0004 00") + b"k" + hexa("FB 81 FF"),  # group with a reference: no keyframe
    ]
    inner = hexa("E7 82 03E8") + b"".join(blocks)
    cluster = hexa("1F43B675") + bytes([0x80 | len(inner)]) + inner
    start = len(info) + len(track)
    cues = hexa("1C53BB6B 8E BB 8C B3 82 03E9 B7 86 F7 81 05 F1 81") + bytes([start])
    media = head + hexa("18538067 01FFFFFFFFFFFFFF") + info + track + cluster + cues
    got = matroska.Parser(media).parse()
    ms = 1_000_000
    assert [(p[2], p[3], p[4], media[p[5] : p[5] + p[6]], p[7]) for p in got] == [
        (1001 * ms, True, "none", b"ab", True),
        (1002 * ms, False, "xiph", b"x", False), (1002 * ms + 100, False, "xiph", b"yy", False), (1002 * ms + 200, False, "xiph", b"zz", False),
        (1003 * ms, True, "fixed", b"pp", False), (1003 * ms + 100, True, "fixed", b"qq", False),
        (999 * ms, False, "ebml", b"a", False), (999 * ms + 100, False, "ebml", b"bb", False), (999 * ms + 200, False, "ebml", b"tail12", False),
        (1004 * ms, False, "none", b"k", False),
    ]
    assert {p[:2] for p in got} == {(5, "S_ABC")}


def test_numbers_out_of_range_are_damage():
    for time_, scale in ((1 << 62, 1_000_000), ((1 << 64) - 1, 1), (5, (1 << 63) - 1), (1 << 200, 1)):
        body = matroska.element(matroska.INFO, matroska.number(matroska.SCALE, scale))
        good = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIME, 0) + matroska.element(matroska.SIMPLE, b"\x81\0\0\x80ok"))
        bad = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIME, time_) + matroska.element(matroska.SIMPLE, b"\x81\0\0\x80no"))
        media = matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, body + good + bad + good)
        got = matroska.Parser(media).parse()
        assert [media[p[5] : p[5] + p[6]] for p in got] == [b"ok"] and matroska._batch([(1, 0, *got[0])]).num_rows == 1
    rng = random.Random(11)
    whole = matroska.write([b"line %d" % i for i in range(60)])
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 8)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        if rows := [(1, i, *p) for i, p in enumerate(matroska.Parser(bytes(data)).parse())]:
            matroska._batch(rows)


# --- tokens -------------------------------------------------------------------------------------------


def naive_count(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return len(parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_counts_equal_the_naive_merge_and_a_public_encoder():
    import tiktoken

    ranks = tokens.read_ranks(tokens.VOCABULARY)
    counter = tokens.Counter(ranks)
    encoder = tiktoken.Encoding("x", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    letters = "abcdeé ñß\n\t'019.,!  ☃漢"
    for n in [0, 1, 2, 30, 400] * 20:
        text = "".join(rng.choice(letters) for _ in range(n))
        assert counter.count(text) == len(encoder.encode_ordinary(text))
    for _ in range(200):
        piece = "".join(rng.choice("theinraso") for _ in range(rng.randint(1, 25))).encode()
        assert tokens.count_piece(piece, ranks) == (1 if piece in ranks else naive_count(piece, ranks))
    assert counter.count(None) == 0


# --- licenses -----------------------------------------------------------------------------------------


def test_edited_notices_are_found_where_they_stand():
    rng = random.Random(5)
    find = licenses.finder(licenses.NOTICES, licenses.CHARACTERS_PER_EDIT)
    for number, (_, notice) in enumerate(licenses.NOTICES):
        for _ in range(15):
            text, k = list(notice), licenses.edits_of(notice)
            for _ in range(rng.randint(0, k)):
                i = rng.randrange(1, len(text) - 1)
                kind = rng.randrange(3)
                text[i : i + (kind != 1)] = [] if kind == 0 else [rng.choice("xyzé")] if kind == 1 else ["q"]
            made = "Été, " * rng.randint(0, 9) + "".join(text).upper() + " and more"
            hits = [h for h in find.find(made) if h[0] == number]
            low = licenses.fold(made)
            brute = regex.search(f"(?b)(?:{regex.escape(licenses.fold(notice), literal_spaces=True)}){{e<={k}}}", low)
            assert (len(hits) == 1) == bool(brute)
            assert hits[0][3] == sum(brute.fuzzy_counts)


def brute_copies(notice, k, low):
    """The fewest edits first, then the leftmost: searched in all that is left of the text, again and again."""
    search, free, out = regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}").search, [(0, len(low))], []
    while True:
        hits = [(sum(m.fuzzy_counts), m.start(), m.end(), f) for f in free if (m := search(low, *f))]
        if not hits:
            return sorted(out)
        e, a, b, f = min(hits)
        out.append((a, b, e))
        free.remove(f)
        free += [(f[0], a), (b, f[1])]


def test_many_edited_copies_in_one_text():
    rng = random.Random(14)
    find = licenses.finder(licenses.NOTICES, licenses.CHARACTERS_PER_EDIT)
    for number in (0, 1, 6, 9):
        notice = licenses.NOTICES[number][1]
        for _ in range(12):
            made, n = "", rng.randint(1, 5)
            for _ in range(n):
                text = list(notice)
                for i in rng.sample(range(3, len(text) - 3), rng.randint(0, licenses.edits_of(notice))):
                    text[i] = rng.choice("xyzq")
                made += "".join(text) + rng.choice([".\n", "; and then, ", " "])
            got = [h[1:] for h in find.find(made) if h[0] == number]
            want = brute_copies(licenses.fold(notice), licenses.edits_of(notice), licenses.fold(made))
            assert len(got) == len(want) == n and [x[2] for x in got] == [x[2] for x in want]


def test_thousands_of_edited_notices_and_an_exact_one():
    find = licenses.finder(licenses.NOTICES, licenses.CHARACTERS_PER_EDIT)
    exact = licenses.NOTICES[0][1]
    edited = exact.replace("Apache", "Apbche")
    began = time.process_time()
    got = find.find((edited + "\n") * 3000 + exact)
    assert [x[3] for x in got if x[0] == 0] == [1] * 3000 + [0] and time.process_time() - began < 60


def test_edit_distances_by_bits():
    rng = random.Random(15)
    for _ in range(800):
        a, w, k = "".join(rng.choice("abc") for _ in range(rng.randint(4, 12))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 20))), rng.randint(0, 3)
        places = {}
        for i, c in enumerate(a):
            places[c] = places.get(c, 0) | 1 << i
        assert licenses.near(places, len(a), w, k) == bool(regex.search(f"(?:{a}){{e<={k}}}", w))


def test_clean_texts_have_no_notice():
    find = licenses.finder(licenses.NOTICES, licenses.CHARACTERS_PER_EDIT)
    for text in ("", "İ" * 50, "a" * 100_000, "the license of the software is not stated here"):
        assert find.find(text) == []


# --- language -----------------------------------------------------------------------------------------


def greedy_phrases(text, labelled):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in labelled:
            k += 1
        at, n = at + k, n + 1
    return n


def test_phrases_equal_the_greedy_parse():
    rng = random.Random(6)
    make = lambda a, n: bytes(rng.choice(a) for _ in range(n))
    labelled = {"a": make(b"abc ", 300), "b": make(b"bcd ", 250)}
    p = langid.Parser(labelled)
    texts = [make(b"abcd ", rng.randint(0, 80)) for _ in range(60)]
    offsets = np.cumsum([0, *map(len, texts)])
    got = p.phrases(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, text in enumerate(texts):
        for k, name in enumerate(p.languages):
            assert got[k, i] in (greedy_phrases(text, labelled[name]), greedy_phrases(text, labelled[name]) - 1)


# --- simhash and alignment ------------------------------------------------------------------------------


def test_simhash_is_of_the_set_of_words():
    col = pa.array(["One two, three!", "three TWO one one", None, "", "...", "one two four", "..."])
    h, has = simhash.hashes(col)
    assert h[0] == h[1] and h[4] == h[6] and has.tolist() == [True, True, False, False, True, True, True]


def test_alignment_equals_the_table():
    rng = np.random.default_rng(7)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 25))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i, j] = max(0, t[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), t[i - 1, j] - 1, t[i, j - 1] - 1)
        assert align(a, b) == t.max()


def test_words_do_not_cross_rows():
    h, first = words(pa.array(["ab", "ab cd", None, "", "É é"]))
    assert np.diff(first).tolist() == [1, 2, 0, 0, 2] and h[0] == h[1] and h[3] == h[4]


def test_n_grams_that_many_items_share_are_sorted_in_parts(monkeypatch):
    from cloakframe.llm import decontaminate

    rng = random.Random(16)
    some = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    items = ["which of the following is best " + some(20) for _ in range(300)]
    h, first = words(pa.array(items))
    held = decontaminate.Items(np.arange(300), h, first)
    texts = pa.array(["which of the following is best " + some(200) for _ in range(20)] + [items[7] + " " + items[9], None, ""] + [some(5) + " " + items[250] + some(5)])
    want = held.scores(texts, 0.5)
    assert {(20, 7, 1.0), (20, 9, 1.0)} <= set(want)
    monkeypatch.setattr(decontaminate, "SEEDS", 50)
    assert sorted(held.scores(texts, 0.5)) == sorted(want)
