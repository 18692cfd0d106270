import pytest

from docweave.llm import pii

NAMES = [("Olive", "given"), ("Élodie", "given"), ("Otto", "given"), ("Íñigo", "given"), ("Abberwick", "family"), ("Bröselkamp", "family"), (None, "given")]


def names():
    return pii.Names([n for n, k in NAMES if n and k == "given"], [n for n, k in NAMES if n and k == "family"])


def spans(text):
    return sorted((k, text[a:b]) for k, a, b, _, sure in pii.find_spans(text, names()) if sure)


@pytest.mark.parametrize(
    "text, kind, item",
    [
        ("Write to {} if you need it.", "email", "olive99@quillbox.example"), ("Questions? {}. Go.", "email", "o.abberwick+subs @ post.reedling.example"), ("Ask\n{}", "email", "olive (at) ortiga\n(dot) test"),
        ("X {} - y", "email", "Olive_1[at]Larkpost.Example"), ("Mail {} now", "email", "olive at quillbox dot example"), ("An {}!", "email", "оlive@quillbox.example"),
        ("Call {} now.", "phone", "+1 455 555 0149"), ("Call {}.\nIt rains.", "phone", "(849) 555-0176"), ("Ring {}, ask.", "phone", "555-0102"), ("Tel {}", "phone", "020 7946 0131"), ("IS {}, CALL", "phone", "+44 20 7946 0753"),
        ("Ruf {} an.", "phone", "030/23125413"), ("Ruf {} an.", "phone", "0049 30 23125358"), ("Ruf {} an.", "phone", "+49 30 23125-099"), ("EST LE {}, APRÈS", "phone", "01-99-00-80-47"), ("le {} avant", "phone", "0199 00 0751"),
        ("al {} esta", "phone", "0034555113948"), ("al {} esta", "phone", "555-2496-31"), ("al {} esta", "phone", "555 55\n36 17"), ("Ring {}, ask", "phone", "555-0l51"), ("le {}.\nIl faut", "phone", "01 99 00 39 13"),
        ("Call {} please", "phone", "five five five oh one four nine"),
        ("Passport {}, issued", "identity", "923-95-7522"), ("number? {}. You", "identity", "QQ357903A"), ("number: {}. You", "identity", "QQ 24 93\n24 C"), ("Steuernummer? {}.", "identity", "00 415 533 178"), ("Ausweis {}, im", "identity", "00/390/03664"),
        ("Ausweis {}, im", "identity", "X0025T0090"), ("sécu ? {}.", "identity", "9 25 56 99 649 548 62"), ("sécu ? {}.", "identity", "X95ZZ25030"), ("es {}, de", "identity", "00.577.467-G"), ("es {}, de", "identity", "X0030873L"),
        ("Live at {}, second floor.", "address", "42 Nettlebed Lane"), ("Meet outside {}.", "address", "162B Gullfeather St"), ("at {}, second", "address", "84B Candlewick Ave."), ("TO {}. I", "address", "19A OLD TANNERY LANE"),
        ("in der {}, zweiter", "address", "Ginsterweg 139"), ("in die {}.", "address", "Alte\nGerbergasse 37B"), ("x, {}, y", "address", "Kranichstraße 62B"), ("Ich, {}\n030", "address", "Am Möwenstieg 94"),
        ("au {}.", "address", "59A bis, avenue du Vieux-Lavoir"), ("J'habite {}, deuxième", "address", "71 bis, rue des Aubépines"), ("au {} 01-99", "address", "88 quai aux Orties"), ("au {}. On", "address", "106 bd. des\nSalines"),
        ("en {}, segundo", "address", "Avda. de la Salina, nº 146a"), ("a {}.", "address", "C/ Ortiga, 78a"), ("en {},", "address", "Plaza del Mirlo nº 170"), ("EN {}, SEGUNDO", "address", "CALLE DEL CARDO 103B"),
        ("I met {} there.", "person", "Olive Abberwick"), ("I met {} there.", "person", "Olive R. Dunsellow"), ("They buried {} there", "person", "Abberwick, Olive"), ("met {} x", "person", "Otto\nBröselkamp"), ("met {} x", "person", "Elodie Broselkamp"),
        ("{}: go", "person", "OLIVE ABBERWICK"), ("met {} x", "person", "0live Abberwick"), ("met {} x", "person", "?lodie Br?selkamp"), ("met {} x", "person", "�lodie Br�selkamp"),
    ],
)
def test_found(text, kind, item):
    assert (kind, item) in spans(text.format(item))
    cue = f"1\n00:00:01,000 --> 00:00:02,000\nHello.\n\n2\n00:00:03,000 --> 00:00:04,000\n{text.format(item)}\n"
    assert (kind, item) in spans(cue) and (kind, item.replace("\n", "\r\n")) in spans(cue.replace("\n", "\r\n"))


@pytest.mark.parametrize(
    "text",
    [
        "Order 5085-479-9615 never arrived.", "Batch 65-402789, shelf nine.", "Lot 842-242/B, étagère.", "Lote 555-0142, estante", "The reel says 03:82:37.", "Rip by @quietfox - rate us 5 stars", "Download at subs-lagoon.example", "Olive, wait! You forgot it.",
        "I told Olive about it. We left.", "Room 42, second door past the mill.", "That makes 13 this week.", "1\n00:00:01,000 --> 00:00:02,000\nHi\n", "50% off with code LEAF22", "KOMMT OTTO HEUTE", "In 1971 they counted 190 rings.", "Im Jahr 1952 zählte er genau 606.", "Am Ende 5 Tage.", "THEY COUNTED 331 ROPE FERRULES? IN WHICH YEAR", "", "Is Olive coming to the Old Mill?",
    ],
)
def test_not_found(text):
    assert spans(text) == []


def test_offsets_in_wrong_encodings():
    text = "OÃ¹ est Ã\x89lodie ? Écris Ã\xa0 olive@ortiga.test. Bringt die Kiste in die KranichstraÃŸe 62B, Otto BrÃ¶selkamp!"
    assert spans(text) == [("address", "KranichstraÃŸe 62B"), ("email", "olive@ortiga.test"), ("person", "Otto BrÃ¶selkamp")]
    twice = "Otto Bröselkamp, Kranichstraße 62B".encode().decode("latin-1").encode().decode("latin-1")
    assert spans(twice) == [("address", twice[twice.index("K") :]), ("person", twice[: twice.index(",")])]


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, pii_type string")
    listed = spark.createDataFrame(NAMES, "name_part string, part_kind string")
    return docs, pii.personal_data(docs, listed)


def test_family_names_are_learned_from_the_corpus(spark):
    rows = [(1, "I saw Olive Dunsellow."), (2, "OLIVE DUNSELLOW, WAIT. OLIVE COMES."), (3, "Dunsellow, Otto went."), (4, "Kommt, Otto lacht."), (5, None), (6, ""), (1, "I saw Olive Dunsellow.")]
    docs, found = run(spark, rows)
    text = dict(reversed(rows))
    assert sorted((r.doc_id, r.pii_type, text[r.doc_id][r.char_start : r.char_end]) for r in found.collect()) == [(1, "person", "Olive Dunsellow"), (2, "person", "OLIVE DUNSELLOW"), (3, "person", "Dunsellow, Otto")]


def test_redaction(spark):
    rows = [(1, "Ring 555-0102, Olive Abberwick!"), (2, "nothing"), (3, None), (1, "something else"), (None, "olive@ortiga.test"), (5, "I saw Olive Dunsellow."), (6, "OLIVE DUNSELLOW, WAIT. OLIVE COMES."), (6, "OLIVE COMES, 555-0102")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, row string")
    listed = spark.createDataFrame(NAMES, "name_part string, part_kind string")
    expected = [(1, "Ring [PHONE], [PERSON]!", 2), (2, "nothing", 0), (3, None, 0), (1, "something else", 0), (None, "[EMAIL]", 1), (5, "I saw [PERSON].", 1), (6, "[PERSON], WAIT. OLIVE COMES.", 1), (6, "OLIVE COMES, [PHONE]", 1)]
    assert sorted(map(str, [tuple(r) for r in pii.redact(docs, listed).collect()])) == sorted(map(str, expected))
    assert pii.redacted("abcdef", [(1, 3, "email"), (2, 5, "phone")]) == "a[EMAIL]f"
    empty, none = run(spark, [])
    assert none.count() == 0 and pii.redact(empty, listed).count() == 0


@pytest.mark.parametrize(
    "text, kind, item",
    [
        ("Call {}, ask", "phone", "07700 900123"), ("Call {}.", "phone", "+44 7700 900123"), ("Ruf {} an", "phone", "030 123456"), ("Ruf {} an", "phone", "+49 30 123456"), ("Ruf {} an", "phone", "0171 1234567"), ("Call {}.", "phone", "2025550143"),
        ("Call {} now", "phone", "+4915112345678"), ("Call {}", "phone", "202-555-0147"), ("Call {}", "phone", "1-800-555-0199"), ("Mum says {}", "phone", "(212) 555-0147"), ("My pilot: {}", "phone", "555-0102"), ("Call {} now", "phone", "five five five 123 4567"),
        ("Passport {}, issued", "identity", "C01X00T47"), ("my ssn is {}", "identity", "one two three four five six seven eight nine"), ("Call {}.", "phone", "triple five oh one four nine"),
        ("mail {} now", "email", "j o h n @ example . com"), ("mail {} now", "email", "john_AT_example_DOT_com"), ("mail {}!", "email", "john&#64;example&#46;com"), ("mail {}", "email", "ana arroba correo punto es"),
        ("at {}.", "address", "12 Broadway"), ("at {}, ask", "address", "1234 Elm Pkwy"), ("at {}.", "address", "5 Queens Walk"),
    ],
)
def test_numbers_by_plan_and_disguises(text, kind, item):
    assert spans(text.format(item)) == [(kind, item)]


@pytest.mark.parametrize("text", ["Order number one two three four five six seven eight", "On 01.02.1990 at noon", "01-02-1990 12 ropes", "It says 03.82.37", "In 1980 Elm Walk was built.", "+44 20 of 7", "Lot 555-0102", "a @ noon. Then"])
def test_numbers_of_things(text):
    assert spans(text) == []


def test_recall_on_planted_items():
    """Items of every type in every disguise, at random, in cues: the share that comes out with its exact span."""
    import random

    rng = random.Random(11)
    words = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))
    alike = str.maketrans("aeopc", "аеорс")
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def mailbox():
        name, site = rng.choice(["olive", "otto.b", "el_99"]), rng.choice(["quillbox", "post.reedling"])
        at, dot = rng.choice([("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("&#64;", "."), ("_AT_", "_DOT_")])
        made = f"{name}{at}{site}{dot}example"
        return "email", made.translate(alike) if at == "@" and rng.random() < 0.3 else made

    def phone():
        kind = rng.randrange(5)
        if kind == 0:
            return "phone", f"+{rng.choice(['44', '49', '33', '34'])} {rng.randint(1, 9)}{digits(1)} {digits(4)} {digits(4)}"
        if kind == 1:
            return "phone", f"({rng.randint(200, 999)}) 555-{digits(4)}"
        if kind == 2:
            return "phone", f"0{rng.randint(1, 9)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"
        if kind == 3:
            return "phone", f"0{rng.randint(10, 99)}/{rng.randint(1, 9)}{digits(7)}"
        return "phone", " ".join(words[c] for c in "555" + digits(rng.choice([4, 7])))

    def identity():
        return "identity", rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"QQ{digits(6)}C", f"{digits(2)}.{digits(3)}.{digits(3)}-G"])

    def person():
        given, family = rng.choice(["Olive", "Otto", "Élodie"]), rng.choice(["Abberwick", "Bröselkamp", "Dunsellow"])
        return "person", rng.choice([f"{given} {family}", f"{given} R. {family}", f"{given}\n{family}", f"{given} {family}".encode().decode("latin-1")])

    def address():
        return "address", rng.choice([f"{rng.randint(1, 199)}{rng.choice(['', 'B'])} Nettlebed Lane", f"Ginsterweg {rng.randint(1, 199)}", f"{rng.randint(1, 99)} bis, rue des Aubépines", f"Plaza del Mirlo nº {rng.randint(1, 199)}"])

    hit = total = 0
    for n in range(600):
        kind, item = rng.choice([mailbox, phone, identity, person, address])()
        total += 1
        hit += (kind, item) in spans(f"1\n00:00:01,000 --> 00:00:02,000\nHello there.\n\n2\n00:00:03,000 --> 00:00:04,000\nit is {item}, they said.\n")
    assert hit / total >= 0.98, hit / total  # 1.0 when written


def test_very_long_text():
    text = "x" * 300_000 + " olive@ortiga.test " + "9" * 100_000 + " Olive Abberwick " + "Aa " * 50_000
    assert spans(text) == [("email", "olive@ortiga.test"), ("person", "Olive Abberwick")]


@pytest.mark.parametrize("around", ["Call {}!", "Call {}?", '"{}," she said', "<i>{}</i>", "({})", "Tel: {};", "-{}…"])
@pytest.mark.parametrize("item", ["five five five oh one four nine", "plus four four two oh seven nine four six oh", "FÜNF FÜNF FÜNF NULL EINS VIER NEUN", "ſix ſix ſix oh one four nine"])
def test_spelled_numbers_beside_other_signs(around, item):
    assert spans(around.format(item)) == [("phone", item)]


@pytest.mark.parametrize(
    "text, kind, item",
    [
        ("Call {} now", "phone", "five five five 0149"), ("Call {}!", "phone", "+44 two oh seven nine four six oh one three one"), ("Call {}, ask", "phone", "double five five oh one four nine"), ("Ring {}.", "phone", "555 oh one four nine"),
        ("Call {}, 12 ropes.", "phone", "five five five oh one four nine"), ("My passport number {}, issued", "identity", "nine two three nine five seven five two two"), ("number {}.", "identity", "nine two three, nine five, seven five two two"),
        ("Steuernummer? {}.", "identity", "null null vier eins fünf fünf drei drei eins sieben acht"), ("Call {}.", "phone", "FIVE FIVE FIVE\n0149"),
    ],
)
def test_numbers_in_words(text, kind, item):
    assert spans(text.format(item)) == [(kind, item)]


@pytest.mark.parametrize("text", ["Order five five five oh one four nine never came.", "Batch number five five five 0149", "One, two, three, 1999 ropes.", "one two three 12", "un deux trois", "One two three\n\n1234567"])
def test_words_that_are_no_number_of_a_person(text):
    assert spans(text) == []


@pytest.mark.parametrize(
    "text, item", [("My name is {}, I came", "OLIVE BR�SELKAMP"), ("{}: Ohne den", "OTTO BR?SELKAMP"), ("IST DAS {}", "OTTO BRÖSELKAM?"), ("{} WAR DA", "BR?SELKAMP, OTTO"), ("and then {} said it", "OLIVE DUNSELLOW")]
)
def test_families_in_capitals(text, item):
    assert spans(text.format(item)) == [("person", item)]


@pytest.mark.parametrize("text", ["J'AI VU OTTO HIER SOlR.", "KOMMT OTTO HEUTE", "OTTO COMES."])
def test_capitals_that_stay_open(text):
    assert spans(text) == []


def test_lost_letters_of_learned_families(spark):
    rows = [(1, "I saw Olive Dunsellow."), (2, "OLIVE DUNS?LLOW, WAIT."), (3, "OTTO D�NSELLOW COMES"), (4, "OTTO D?NS?MMER COMES")]
    text = dict(rows)
    assert sorted((r.doc_id, text[r.doc_id][r.char_start : r.char_end]) for r in run(spark, rows)[1].collect()) == [(1, "Olive Dunsellow"), (2, "OLIVE DUNS?LLOW"), (3, "OTTO D�NSELLOW")]
