from lekhya.operators import hierarchy, metadata

TEXT = """संशोधन गर्ने ऐन
१. केही ऐन, २०६४
परिच्छेद-१
प्रारम्भिक
१. संक्षिप्त नाम: (१) यस ऐनको नाम हो।
(२) यो ऐन दफा २३ बमोजिम लागू हुनेछ।
(क) पहिलो
(ट) दोस्रो
अनुसूची-२
विवरण"""


def parse(spark, text, slug="act", year=2063):
    docs = spark.createDataFrame([("d", slug, year, text)], "doc string, slug string, bs_year int, text string")
    return hierarchy.parse(docs).orderBy("ord").collect()


def test_act(spark):
    got = parse(spark, TEXT)
    assert [(c.id, c.type, c.text, c.stats.characters, c.stats.tokens) for c in got] == [
        ("act-2063-ch1-sec1", "section", "(१) यस ऐनको नाम हो।", 19, 7),
        ("act-2063-ch1-sec1-sub2", "subsection", "यो ऐन दफा २३ बमोजिम लागू हुनेछ।", 31, 10),
        ("act-2063-ch1-sec1-sub2-clक", "clause", "पहिलो (ट) दोस्रो", 16, 4),
        ("act-2063-anusuchi2", "anusuchi", "अनुसूची-२ विवरण", 15, 3),
    ]
    assert tuple(got[0].hierarchy) == (1, "प्रारम्भिक", 1, "संक्षिप्त नाम", None, None)
    assert [tuple(r) for r in got[1].refs] == [("section", "act-2063-sec23", "दफा २३")]
    assert got[0].refs is None and got[0].provisos is None


def test_title_takes_the_next_line(spark):
    got = parse(spark, "परिच्छेद-१\n१. क\n(१) ख\n(२) ग")
    assert [(c.id, c.hierarchy.ch_title) for c in got] == [("act-2063-ch1-sec1-sub2", "(१) ख")]  # of section 1 nothing but its title is left


def test_provisos(spark):
    got = parse(spark, "१. क: गर्नेछ। तर यस्तो तर उस्तो\n२. ख: अन्तर भएको\n३. ग: क । तर ख स्पष्टीकरणः ग\n४. घ: च स्पष्टीकरणः छ")
    assert [(c.text, c.provisos, c.explanations) for c in got] == [
        ("गर्नेछ।", ["तर यस्तो"], None), ("अन्", ["तर भएको"], None), ("क ।", ["तर ख स्पष्टीकरणः ग"], None), ("च", None, ["स्पष्टीकरणः छ"]),
    ]


def test_front_matter(spark):
    lines = [f"शब्द {i}" for i in range(25)]
    assert parse(spark, "\n".join(lines))[0].text == " ".join(lines[20:])
    assert parse(spark, "क\nसूचना\nख")[0].text == "सूचना ख"
    assert parse(spark, "क\n\n ख ") == [] and parse(spark, None) == [] and parse(spark, "") == []
    assert parse(spark, "१. क: ख", year=None)[0].id == "act-None-sec1"


def test_references(spark):
    got = parse(spark, "१. क: उपदफा (१) र दफा २३ खण्ड (ट)")
    assert [r.id for r in got[0].refs] == ["act-2063-sub1", "act-2063-sec23"]


def test_pages(spark):
    pages = spark.createDataFrame([("d", 2, "१. क: ख\n\n 12 \n\nग"), ("d", 1, "  a   b "), ("e", 1, None)], "doc string, page_no int, text string")
    got = {r.doc: r.text for r in hierarchy.pages_to_text(pages).collect()}
    assert got == {"d": "a b\n१. क: ख\n\nग", "e": ""}


def meta(spark, text):
    return metadata.extract(spark.createDataFrame([(text,)], "text string")).collect()[0].act_metadata


def test_metadata(spark):
    m = meta(spark, "नेपाल राजपत्र\nकम्पनी ऐन, २०६३\nप्रमाणीकरण र प्रकाशित मिति\n२०६३ । ७ । १८\nसंशोधन गर्ने ऐन\n१. पहिलो ऐन,\n२०६४ २०६४।५।१२\n२. दोस्रो ऐन\nपरिच्छेद-१\n३. तेस्रो")
    assert (m.title, m.bs_year, m.type, m.date_published, m.date_commenced) == ("कम्पनी ऐन, २०६३", 2063, "act", "२०६३।७।१८", None)
    assert [tuple(r) for r in m.amended_refs] == [("पहिलो ऐन, २०६४", "२०६४।५।१२"), ("दोस्रो ऐन", "")]


def test_metadata_fallbacks(spark):
    m = meta(spark, "शीर्षक विनियमावली\nवर्ष २०७०")
    assert (m.title, m.type, m.bs_year) == ("शीर्षक विनियमावली", "regulation", 2070)
    assert meta(spark, "अधिसूचना").type == "notice"
    m = meta(spark, "प्रमाणीकरण मिति २०६४।५।१२")
    assert (m.title, m.bs_year, m.date_commenced) == ("Unknown Act", 2064, "२०६४।५।१२")
    assert meta(spark, "प्रमाणीकरण मिति २०६४-५-१२").date_commenced is None
    m = meta(spark, None)
    assert (m.title, m.bs_year, m.amended_refs) == ("Unknown Act", None, [])
