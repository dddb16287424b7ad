"""Stuffed pages."""

import pandas as pd

from aubade.llm.spam import found_spam
from tests.conftest import rows

SCHEMA = "doc_id bigint, lang string, text string, chars string"
HONEST = [
    "On the second evening, the soloist chooses a broad tempo and the orchestra follows without complaint. In this recording, a new edition corrects 45 errors in the viola part, which few people noticed. Little is known about the early life of the composer, who was born by the sea and taught the cello there.",
    "The refrain returns.\nSing, my heart, of the morning light,\nover the hills and away we go.\nThe river ran low in the summer of old,\nand nobody knew where the ferryman slept.\nSing, my heart, of the morning light,\nover the hills and away we go.\nA lamp in the window, a coat on the stair,\nthe letters unopened, the garden in snow.\nSing, my heart, of the morning light,\nover the hills and away we go.",
    "12:31 AM\nAnna Lund (1700-1750)\nSonata No. 4 in C minor\nHarbour Radio Choir\n\n12:52 AM\nPeter Oster (1812-1870)\nTrio in F major, Op. 12\nNorthern Chamber Orchestra\n\n1:20 AM\nClara Weil (1901-1980)\nNocturne for strings, Op. 3\nGlass Mountain Philharmonic",
    "Adler, Jonas\nBergmann, Ilse\nCarver, Thomas\nDemers, Odile\nEkholm, Sven\nFarkas, Zoltan\nGrieve, Alison\nHallam, Ruth\nIversen, Nils\nJanacek, Petra\nKowal, Marek\nLindqvist, Maja",
]
SPAM = [
    "cheap sheet music, sheet music sale, buy sheet music online, sheet music discount, best sheet music, sheet music near me, new sheet music, top sheet music, official sheet music, sheet music deal, sheet music free shipping, lowest price sheet music, review sheet music",
    "http://shop.example/sheet-music-12\nwww.deals.test/cheap-harp?id=4\n[buy harp](https://harps.example/buy/88)\n<a href=\"http://a.test/1.html\">harp sale</a>\nhttp://shop.example/harp-sale-77",
    "#sheetmusic #buysheetmusic #sheetmusicsale #cheapsheetmusic #sheet_music #bestsheetmusic #sheetmusic #sheetmusicdeal",
    "harp for hire - SKU 35811 - 4.99 - last one\nharp for hire sale - SKU 49256 - 87.99 - new\nbest harp for hire - SKU 11111 - 9.99 - used\ncheap harp for hire - SKU 22222 - 19.99 - new",
]


def test_pages(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    base["doc_id"] += 1_000_000
    extra = pd.DataFrame([(i, "en", x) for i, x in enumerate(HONEST)] + [(100 + i, "en", x) for i, x in enumerate(SPAM)] + [(200, None, SPAM[0]), (200, None, SPAM[0]), (300, "en", None), (301, "en", ""), (302, "en", "  \n "), (303, "xx", SPAM[0] * 3000), (304, "en", HONEST[0] + "\n" + SPAM[1])], columns=["doc_id", "lang", "text"])
    data = pd.concat([base, extra])
    df = spark.createDataFrame([(int(a), b, c, "x") for a, b, c in data.itertuples(index=False)], SCHEMA).repartition(3)
    found = [r[0] for r in rows(found_spam(df)) if r[0] < 1_000_000]
    assert sorted(found) == [100, 101, 102, 103, 200, 303]


def test_empty(spark):
    assert found_spam(spark.createDataFrame([], SCHEMA)).count() == 0
