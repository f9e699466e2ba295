"""Label repair against known strings; the dictionary rows that some need are test data."""

import pytest

from atlasloom.functions import arbitration as arb
from atlasloom.functions import repair as r
from atlasloom.functions.lexicon import Lexicon

WORDS = "quán cà phê|Hồ Chí Minh|nhà thuốc|Tân Định|Bún bò|Đà Lạt|Phở bò|Miến Phở Gà|Gia Định|Nhà thờ Đức Bà|Cổng Đường sách|Lê Duẩn|Công viên Hàn Thuyên|Cổng sau Trường Đại học Kỹ thuật|Ăn|An"
PLAIN = r.Repair()
FULL = r.Repair(Lexicon.build(places=WORDS.split("|")))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Sửa Xẻ Máy", "Sửa Xe Máy"),
        ("Hello Thọ - Cứu Hộ Xe", "Hello Thợ - Cứu Hộ Xe"),
        ("Ăn Vật - Nước Mia", "Ăn Vặt - Nước Mía"),
        ("Đồ Cũng Trọn Gói", "Đồ Cúng Trọn Gói"),
        ("THE COFFEE LAB", "THE COFFEE LAB"),
        ("Highlands Coffee Saigon Post Office", "Highlands Coffee Saigon Post Office"),
        ("wăbẽ săbẽ boutique", "wăbẽ săbẽ boutique"),
        ("MCM Post Office", "MCM Post Office"),
        ("", ""),
    ],
)
def test_spelling(text, expected):
    assert PLAIN.spelling(text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Pravered / Tiệm Nhà Nấm 89", "Tiệm Nhà Nấm 89"),
        ("Bình Bình Quán", "Bình Quán"),
        ("Cổng Đường sách TP TP Hồ Chí Minh", "Cổng Đường sách TP Hồ Chí Minh"),
        ("Haeduri Hai Bà Trưng", "Haeduri Hai Bà Trưng"),
        ("dirrom Hai Bà Trưng", "Hai Bà Trưng"),
        ("VIET TUI XÁCH / Fashion accessories store", "VIET TUI XÁCH"),
        ("OHQUAO Souvenir Dept / Souvenir store", "OHQUAO Souvenir Dept"),
        ("TUMI Saigon Central / LPost Office Store", "TUMI Saigon Central / Post Office Store"),
        ("LEfora", "Efora"),
        ("LEfola", "Efora"),
        ("LPBank PGD Bưu điện", "LPBank PGD Bưu điện"),
        ("Olivia's Prime Steakhouse", "Olivia's Prime Steakhouse"),
        ("Capi Studio DIY Souvenirs &...", "Capi Studio DIY Souvenirs &..."),
        ("125 Hai Bà Trưng", "125 Hai Bà Trưng"),
        ("Văn phòng đăng ký đất đai Chi nhánh Quận 1", "Văn phòng đăng ký đất đai - Chi nhánh Quận 1"),
        ("Ngân hàng Chính sách xã hội Chi nhánh Hà Nội", "Ngân hàng Chính sách xã hội - Chi nhánh Hà Nội"),
        ("237 (HWA PUNG / JEONG) 24]", "HWA PUNG JEONG"),
        ("서울 (THE COFFEE SHOP) 24", "THE COFFEE SHOP"),
        ("Trạm xe đạp công cộng / TNGo - UBND Quận 1", "Trạm xe đạp công cộng / TNGo - UBND Quận 1"),
        ("Vườn Trong Phố, Gia Định Connection", "Vườn Trong Phố, Gia Định Connection"),
        ("Highlands Coffee Saigon Post Office", "Highlands Coffee Saigon Post Office"),
        ("ÁO DÀI AND ÁO BÀ BÀ BA RENTALS", "ÁO DÀI AND ÁO BÀ BA RENTALS"),
        ("ÁO DÀI AND ÁO / BÀ BÀ BA RENTALS", "ÁO DÀI AND ÁO / BÀ BA RENTALS"),
        ("Cà phê phê sữa", "Cà phê sữa"),
        ("Ca phe sua da", "Cà phê sua da"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_final(text, expected):
    assert PLAIN.clean_final(text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Quan ca phe Ho Chi Minh", "quán cà phê Hồ Chí Minh"), ("Nha thuoc Tan Dinh", "nhà thuốc Tân Định"), ("Bun bo Da Lat", "Bún bò Đà Lạt"), ("Quan mien pho ga", "Quan Miến Phở Gà"), ("Vuon Trong Pho Gia Dinh Connection", "Vuon Trong Pho Gia Định Connection")],
)
def test_place_phrases(text, expected):
    assert FULL.place_phrases(text) == expected


def test_repeats():
    assert r.drop_repeats("Tuyền Tuyền / Quán (Thủ Thừa)") == "Tuyền Tuyền / Quán (Thủ Thừa)"
    assert r.drop_repeats("Tuyền Tuyền Quán") == "Tuyền Quán"


def test_marks():
    assert r.merge_best_marks("Hello Thợ", "Hello Thọ") == "Hello Thợ"
    assert r.merge_best_marks("one", "one two") == "one two"


def test_gibberish_and_scores():
    assert PLAIN.gibberish("Têm viên nông nân")
    assert not PLAIN.gibberish("Bếp Nội Nhà Làm")
    assert not PLAIN.gibberish("GEOX")
    assert PLAIN.quality("Trạm xe đạp công cộng / TNGo - UBND Quận 1") > PLAIN.quality("Têm viên nông nân")
    assert PLAIN.junk_tokens("Tiệm Nhà Nấm 89") == 0


def test_rescue():
    tail = ("Vòng xoay Phạm Ngọc", "Phạm Ngọc Thạch giao Lê Duẩn", "Vòng xoay Phạm Ngọc Thạch giao Lê Duẩn")
    assert PLAIN.append_tail(*tail[:2]) == tail[2]
    assert PLAIN.join_readings(*tail[:2]) == tail[2]
    assert PLAIN.append_tail("Nice Weathers", "Nice Weathers The coffee shop") == "Nice Weathers The coffee shop"
    for other in ("Nice Weathers 4.8 (120)", "Nice Weathers coffee shop store", "Other Label Nice Weathers"):
        assert PLAIN.append_tail("Nice Weathers", other) == "Nice Weathers"
    middle = ("Trạm xe đạp công / TNGo - UBND Quận 1", "Trạm xe đạp công cộng / TNGo - UBND Quận 1")
    assert PLAIN.fill_middle(*middle) == middle[1]
    assert PLAIN.join_readings(middle[1], "Tramva văn nân nân") == middle[1]
    kept = "Cổng Đường sách / TP Hồ Chí Minh"
    assert PLAIN.fill_middle(kept, "Cống Đường sách / TP. Hồ Chí Minh") == kept


def test_gaps():
    assert r.gaps(list("abc"), list("abxc")) == ([(2, 3, False)], 0, 0)
    assert r.gaps(list("abc"), list("bcxy")) == ([(2, 4, True)], 1, None)
    assert r.gaps(list("ab"), list("ab")) == ([], 0, 0) and r.gaps([], list("a")).lost == 0
    assert r.gaps(list("ab"), list("xaxb")) == ([(2, 3, False)], 0, 1)


def test_needs_rescue():
    for text in ("", "Tram vin nông nân", "quantousus", "A", "XOKOHAMA"):
        assert PLAIN.needs_rescue(text)
    assert not FULL.needs_rescue("Cổng sau Trường")
    assert not FULL.needs_rescue("Cổng sau Trường Đại học Kỹ thuật Y")


def test_arbitration():
    pairs = [("Hello Thợ-Cứu hộ xe", "Hello Thọ - Cứu Hộ Xe / Máy & Sửa Xe Lưu Động"), ("Đồ cúng Thiên", "Đồ Cúng Thiên / Phúc - CN Phú Mỹ")]
    for primary, other in pairs:
        assert arb.adds_noise(primary, other) and arb.names_more(PLAIN, primary, other)
    rejected = [("Saigon Central / Post Office", "Saigon Central / Post Office / Ao Dai City Tour in Saigon / Group CLR English Chine"), ("MCM Post Office", "MCM Post Office / 5.0 (121) / Luxury for her at DAFC Onl")]
    for primary, other in rejected:
        assert arb.adds_noise(primary, other) and not arb.names_more(PLAIN, primary, other)
    assert arb.regresses(PLAIN, "UBND phường sài Gòn", "JBND - Công Sài Gòn")
    assert not arb.regresses(PLAIN, "Olivia s Prime Steakhouse", "Olivia's Prime Steakhouse")
    assert arb.short_brand(PLAIN, "GEOX")
    assert arb.arbitrate(PLAIN, "Cafe A", "", 1) == "Cafe A"
    assert arb.arbitrate(PLAIN, "Phở Bò", "Phở Bò / Extra", 1) == "Phở Bò"
    assert arb.rescue(PLAIN, "", "", "") == ""


def test_column_rules_follow_string_rules(spark):
    """Columns and strings share word lists; they must agree where both exist."""
    from pyspark.sql import functions as F

    from atlasloom.functions import predicates as p
    from atlasloom.functions import scores as s
    from atlasloom.operators import repair as rp

    texts = ["", "4.5 (12)", "000Trang", "Cons", "fitness", "Steakhouse", "ororiz00ne", "Chợ Nga, TP", "Coffee shop", "ComonESSt", "Phở", "A / Tiệm Bánh", "reverses / Tiệm Bánh Mì / TP", "5Chạt -laan (x)", "Chínhồ đẹpấ", "Priviness / Quán Ăn Ngon", "quantousus 12345"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    c = F.col("t")
    got = df.select("k", p.junk_line(c).alias("line"), p.clean_junk_words(c).alias("words"), p.bad_ocr(c).alias("bad"), p.category_segment(c).alias("cat"), p.clean_edge_segments(c).alias("edges"), p.junk_token_count(c).alias("junk"), s.artifact_score(c).alias("art"), rp.clean_final(rp.ship(spark))(c).alias("final"))
    for row in got.collect():
        t = texts[row.k]
        want = (r.junk_line(t), r.clean_junk_words(t), PLAIN.bad(t), r.category_segment(t), r.clean_edges(t), PLAIN.junk_tokens(t), r.artifacts(t), PLAIN.clean_final(t))
        assert tuple(row)[1:] == want, t


def test_words_are_judged_once():
    """A word that labels repeat is looked up once, and at edges and within them judged as before."""
    from atlasloom.functions.lexicon import Lexicon
    from atlasloom.functions.repair import Repair

    own, asked = Repair(Lexicon.build()), []
    own.lexicon.knows = lambda token: asked.append(token) or False
    assert [own.junk_tokens("x discepter x discepter x") for _ in range(3)] == [4, 4, 4]
    assert asked == ["x", "discepter"]


def test_labels_are_judged_by_their_words():
    """What is kept of words gives what the rules give, for labels that they leave, trim, merge or rewrite; plain labels do not meet the rules."""
    import random

    from atlasloom.functions.judging import Judge
    from atlasloom.functions.repair import Repair

    some = random.Random(3)
    plain = "the reast heatin Onhe a é y nông viên Trãi trai bcdfghjklm LÊ Lê lê là la ABC x".split()
    odd = "ca phe nha và va xe sửa chi nhanh tp con ess mplaza Đsabc BBola EAGLE open obst School ß Σας ΟΔΟΣ İa a1 é a×b an vat hcm ABD".split() + ["", "é"]
    for lexicon in (Lexicon.build(), Lexicon.build(words={"a": "12K reast"}), Lexicon.build(places=["Nông Viên"]), Lexicon.build(targets=[("the", "reast", "heatin", "Onhe")])):
        own = Repair(lexicon, None)
        judge = Judge(own)
        for k in range(3000):
            words = plain + some.sample(odd, k % 4)
            text = " / ".join(" ".join(some.choices(words, k=some.choice((1, 2, 3, 3, 6)))) for _ in range(some.choice((1, 2, 2, 3))))
            text = some.choice(("", "", "", "4.5 (12K) · ", "4,5 (123M) · ", "4.5 (000K) · ", "7 ")) + text
            assert judge.judge(text) == (own.quality(text), own.needs_rescue(text)), text
        assert judge.judge(None) == (own.quality(None), own.needs_rescue(None))
    own = Repair(Lexicon.build())
    own.clean_final = lambda text: pytest.fail(text)
    for text in ("of reast of / heatin onwh", "4.5 (12K) · the the reast / a heatin onwh", "viên la reast / heatin y"):
        Judge(own).judge(text)


def test_quality_score_deals_out_one_row_group(spark, tmp_path):
    """Documents of one row group are judged in several tasks, with labels of nulls left out."""
    from pyspark.sql import functions as F

    from atlasloom.plans.text_queries import quality_score

    rows = [(k, f"the reast of heatin onwh {k} nông viên") for k in range(200)] + [(200, None), (201, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = quality_score(spark, str(tmp_path))
    assert found.columns == ["doc_id", "name_no", "quality", "needs_rescue"]
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    assert found.where("doc_id < 200").count() == 400 and found.where("doc_id = 200").count() == 0
    assert [tuple(r) for r in found.where("doc_id = 201").collect()] == [(201, 0, PLAIN.quality(" / "), PLAIN.needs_rescue(" / "))]
