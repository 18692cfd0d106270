import random

import pytest

from docweave.llm import damage, leaks

ITEM = "In the 1971 survey of Dunnet Slack, the parish archivist counted 190 iron mooring rings along the abandoned ropewalk while two rival cartographers measured the silted millrace"
OTHER = "Every night we whistle and nobody at all leaves the harbour before the very first snow falls on the old tram depot"


def cues(text, width=5, start=1):
    words = text.split()
    return "\n\n".join(f"{n}\n00:00:{n % 60:02d},000 --> 00:00:{n % 60:02d},900\n{' '.join(words[a : a + width])}" for n, a in enumerate(range(0, len(words), width), start))


def search(spark, docs, items=((1, ITEM),), **options):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(list(items), "item_id long, text string")
    index = leaks.CorpusIndex(d, **options)
    return sorted((r.doc_id, r.item_id) for r in leaks.search_items(index, i).collect())


def part(first, n):
    return " ".join(ITEM.split()[first : first + n])


@pytest.mark.parametrize(
    "text",
    [
        part(3, 12), part(3, 12).upper().replace(",", " ..."), cues(part(0, 14)), cues(part(2, 13)).replace("\n", "\r\n"), "WEBVTT\n\n" + cues(part(2, 13)).replace(",000", ".000"),
        "<i>" + cues(part(2, 13), 3) + "</i>", "\n".join(f"KEITH: {line}" if "-->" not in line and not line.isdigit() and line else line for line in cues(part(2, 13)).split("\n")),
        cues(part(2, 13)).replace("counted", "counted [door creaks]").replace("iron", "(LAUGHTER)\niron"), part(3, 14).replace("the", "thc").replace("archivist", "archivlst").replace("mooring", "rnooring"),
        part(3, 14).replace("rings", "ri|gs").replace("along", "a1ong"),
    ],
)
def test_found_in_all_guises(spark, text):
    assert search(spark, [(5, OTHER + "\n" + text + "\n" + OTHER)]) == [(5, 1)]


SHORT = "alpha bravo charlie delta echo foxtrot not golf hotel india juliet kilo"


@pytest.mark.parametrize(
    "text",
    [
        SHORT, SHORT.replace("foxtrot", "foxtrat"), SHORT.replace("not", "nat"), SHORT.replace("not", "net"), SHORT.replace("foxtrot not", "foxtrotnot"), SHORT.replace("hotel", "hot el"), SHORT.replace("not", "nt"), SHORT.replace("alpha bravo", "alphabravo").replace("india", "in dia"),
    ],
)
def test_passages_with_a_word_lost(spark, text):
    assert search(spark, [(5, OTHER + "\n" + text + "\n" + OTHER), (6, cues(OTHER + " " + text, 4))], [(1, SHORT), (2, ITEM)]) == [(5, 1), (6, 1)]


@pytest.mark.parametrize("text", ["alpha bravo charlie delta echo foxtrot or golf two three", "alpha bravo charlie and echo foxtrot not and hotel india juliet and", "alpha bravo charlie delta echo foxtrot one two three golf hotel india juliet kilo", SHORT.replace("golf", "oxen"), SHORT.replace("foxtrot", "tango")])
def test_runs_too_short_or_too_far_apart(spark, text):
    assert search(spark, [(5, OTHER + " " + text + " " + OTHER)], [(1, SHORT)]) == []


def test_recall_on_planted_passages():
    """Passages of 12 to 20 words with up to two misread letters and, in half of them, a blank lost or added."""
    rng = random.Random(3)
    bag = ("whistle nobody harbour before snow falls old tram depot lantern quay not the of and rope mill seven coal river bell over under night keeper gull salt wind shed wharf cargo chart moor tide lock barge clerk it we go on by").split()
    items = [(n, " ".join(rng.choices(bag, k=26))) for n in range(20)]
    docs, expected = [], set()
    for d in range(400):
        i, n = rng.randrange(20), rng.randint(12, 20)
        start = rng.randrange(26 - n + 1)
        words = items[i][1].split()[start : start + n]
        for _ in range(rng.randint(0, 2)):
            w = rng.randrange(n)
            c = rng.randrange(len(words[w]))
            words[w] = words[w][:c] + rng.choice("aeioubdz") + words[w][c + 1 :]
        at = rng.randint(1, n - 2)
        words[at : at + 2] = rng.choice([words[at : at + 2], words[at : at + 2], ["".join(words[at : at + 2])], [words[at][:2], words[at][2:], words[at + 1]]])
        docs.append((d, " ".join([f"x{rng.randrange(900)}" for _ in range(30)] + words + [f"y{rng.randrange(900)}" for _ in range(30)])))
        expected.add((d, i))
    got = search_local(docs, items, 10_000)
    hit = len(got & expected) / len(expected)
    assert hit >= 0.95 and len(got - expected) <= 4, (hit, got - expected)


def test_saved_index_and_blocks_of_items(spark, tmp_path):
    docs = spark.createDataFrame([(n, part(n % 9, 13) if n % 2 else OTHER) for n in range(20)] + [(3, OTHER)] * 3, "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/index"
    leaks.CorpusIndex(docs, segment_tokens=130).save(path)
    index = leaks.CorpusIndex.open(spark, path)
    items = spark.createDataFrame([(1, ITEM), (2, SHORT), (3, OTHER), (1, ITEM)], "item_id long, text string")
    expected = sorted([(n, 1) for n in range(1, 20, 2)] + [(n, 3) for n in range(0, 20, 2)] + [(3, 3)])
    for size in (1, 50_000):
        assert sorted((r.doc_id, r.item_id) for r in leaks.search_items(index, items, block_items=size).collect()) == expected
    heads = index.postings.where("term IS NULL").select("segment").collect()
    assert len(heads) == len({r.segment for r in heads}) > 3


@pytest.mark.parametrize("text", [None, "", OTHER, part(3, 6), part(3, 6) + " something else " + part(9, 6), ITEM.replace("the", "one").replace("of", "at").replace("1971", "1981").replace("190", "191").replace("along", "near").replace("measured", "saw"), part(8, 6) + " " + part(2, 6)])
def test_not_found(spark, text):
    assert search(spark, [(5, text)]) == []


def test_wrong_encodings(spark):
    item = "Les flotteurs de verre laissés près du môle du nord après la onzième crue étaient résistants au sel et très corrodés hier"
    bad = [item.encode().decode("cp1252"), item.encode().decode("latin-1").encode().decode("latin-1"), item.replace("é", "?").replace("ô", "?").replace("è", "?"), item.replace("é", "�").replace("è", "�"), item.encode("cp1252").decode("cp1250"), "".join(c for c in damage.plain(item))]
    assert search(spark, [(n, t) for n, t in enumerate(bad)], [(3, item)]) == [(n, 3) for n in range(len(bad))]


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "mu", "so", "te") for b in ("dran", "fost", "gwim") for c in ("ey", "al", "ux")]
    items = [(n, " ".join(rng.choices(vocabulary, k=30))) for n in range(12)]
    docs = []
    for d in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            item, n = rng.choice(items)[1].split(), rng.choice([4, 6, 12, 15, 20])
            at, start = rng.randint(0, len(words)), rng.randint(0, 30 - n)
            words[at:at] = item[start : start + n]
        docs.append((d, " ".join(words)))

    def longest(a, b):
        best = 0
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, *row)
        return best

    expected = [(d, i) for d, t in docs for i, u in items if longest(t.split(), u.split()) >= leaks.LEAST_WORDS]
    # words of this vocabulary are so alike that near ones are taken for misreadings: only exact ones here
    near, damage.NearWords.near = damage.NearWords.near, lambda self, w: []
    try:
        for size in (10_000, 300):  # one segment, and long documents over several
            got = [p for p in search_local(docs, items, size)]
            assert sorted(got) == sorted(expected)
    finally:
        damage.NearWords.near = near


def search_local(docs, items, size):
    """The same steps without Spark."""
    import pandas as pd

    held = leaks._Items(items)
    frame = pd.DataFrame(docs, columns=["doc_id", "text"])
    out = set()
    for segment in leaks._index(size)(iter([frame])):
        relevant = pd.concat(leaks._relevant(held)(iter([segment])))
        out |= {(r.doc_id, r.item_id) for r in leaks._search(held, leaks.LEAST_WORDS)(relevant).itertuples()}
    return out


def test_proximity(spark):
    shuffled = " ".join(random.Random(1).sample(ITEM.split(), len(ITEM.split())))
    far = (" " + OTHER * 3 + " ").join(ITEM.split())
    docs = [(1, shuffled), (2, OTHER), (3, None), (4, part(0, 10)), (5, ITEM), (6, far)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = leaks.near_items(leaks.CorpusIndex(d), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == [1, 5] and all(r.n_terms <= r.of_terms for r in found)


def test_long_document_and_repeats(spark):
    long = " ".join([OTHER] * 400)
    assert search(spark, [(1, long + " " + part(0, 15) + " " + long), (1, "x"), (2, part(5, 13)), (2, part(5, 13)), (3, long)], segment_tokens=1000) == [(1, 1), (2, 1)]


def test_empty(spark):
    assert search(spark, []) == [] and search(spark, [(1, ITEM)], [(1, None), (2, ""), (3, "...")]) == []


def test_skeletons():
    assert damage.skeleton("thc") == damage.skeleton("the") and damage.skeleton("tbe") == damage.skeleton("the") and damage.skeleton("rnidi") == damage.skeleton("midi")
    assert damage.skeleton("vvell") == damage.skeleton("well") and damage.skeleton("1906") != damage.skeleton("1907") and damage.skeleton("Übung") == damage.skeleton("iibung")
    assert damage.near("resistqnt", "resistant") and not damage.near("1971", "1981") and damage.near("pr?s", "pres")
    assert damage.repaired("Ã©tagÃ¨re â™ª") == "étagère ♪" and damage.repaired("plain") == "plain"
