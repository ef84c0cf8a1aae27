import random

import numpy as np

from faultlens.llm import quality as q

SCHEMA = "doc_id long, text string, score string, kept string, votes int"


def good(rng):
    return " ".join(" ".join(rng.choice(["the", "a", "of", "river", "stone", "quiet", "we", "went", "over", "hill", "and", "old", "paper"]) + str("") + rng.choice("abcdefgh") * (rng.random() < 0.4) for _ in range(12)).capitalize() + "." for _ in range(12))


JUNK = [lambda r: "Spam " * 200, lambda r: "! ".join(good(r).upper().split()), lambda r: " ".join(w + r.choice(["***", "###", "%%%"]) for w in good(r).split()), lambda r: " | ".join(r.choice(["category", "products", "shipping", "accessories"]) + str(i) for i in range(80))]


def rows(n=400):
    rng = random.Random(4)
    return [(i, JUNK[i % 4](rng) if i % 7 == 0 else good(rng), "x", "x", 1) for i in range(n)]


def test_finds_junk_without_labels(spark):
    got = {r.doc_id: r for r in q.classify(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].kept for i in got if i % 7) == sum(1 for i in got if i % 7)
    assert sum(not got[i].kept for i in got if i % 7 == 0) >= 0.9 * sum(1 for i in got if i % 7 == 0)


def test_defined_cases(spark):
    data = [*rows(100), (900, None, "x", "x", 1), (901, "", "x", "x", 1), (902, " \n ", "x", "x", 1), (None, rows(2)[1][1], "x", "x", 1), (1, rows(2)[1][1], "x", "x", 1), (903, rows(2)[1][1] * 500, "x", "x", 1)]
    table = spark.createDataFrame(data, SCHEMA)
    got = q.classify(table).collect()
    assert len(got) == len(data) and all(r.score == 0 and not r.kept for r in got if r.doc_id in (900, 901, 902))
    kept = q.keep_good(table)
    assert kept.columns == table.columns and kept.count() == sum(r.kept for r in got)
    assert q.classify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert q.classify(spark.createDataFrame([(1, None, "x", "x", 1)], SCHEMA)).first().score == 0


#: The same short piece of news in several languages and scripts.
NEWS = {
    "ru": "Сегодня утром в центре города открылась новая библиотека. Её строили почти три года, и жители давно ждали этого дня. На открытии выступил мэр, который поблагодарил архитекторов и строителей. В библиотеке есть читальный зал, детская комната и небольшое кафе. Книги можно взять домой на две недели.",
    "el": "Σήμερα το πρωί άνοιξε στο κέντρο της πόλης μια νέα βιβλιοθήκη. Η κατασκευή της κράτησε σχεδόν τρία χρόνια και οι κάτοικοι περίμεναν αυτή την ημέρα. Στα εγκαίνια μίλησε ο δήμαρχος, που ευχαρίστησε τους αρχιτέκτονες. Η βιβλιοθήκη έχει αναγνωστήριο, παιδική αίθουσα και μικρό καφέ.",
    "ar": "افتتحت صباح اليوم مكتبة جديدة في وسط المدينة. استغرق بناؤها نحو ثلاث سنوات، وكان السكان ينتظرون هذا اليوم منذ زمن طويل. تحدث رئيس البلدية في حفل الافتتاح وشكر المهندسين والعمال. تضم المكتبة قاعة للقراءة وغرفة للأطفال ومقهى صغيرا. هل يمكن استعارة الكتب؟ نعم، لمدة أسبوعين.",
    "zh": "今天早上，市中心的新图书馆正式开放了。图书馆的建设花了将近三年的时间，居民们早就盼望着这一天。市长在开幕式上讲话，感谢了建筑师和工人。图书馆里有阅览室、儿童室和一家小咖啡馆。书可以借回家两个星期，学生还可以在这里安静地学习。",
    "ja": "今朝、町の中心に新しい図書館が開きました。建設には三年近くかかり、住民はこの日を長い間待っていました。開館式では市長があいさつをして、建築家と作業員に感謝しました。図書館には閲覧室と子どもの部屋、小さな喫茶店があります。本は二週間借りることができます。",
    "hi": "आज सुबह शहर के बीच में एक नया पुस्तकालय खुला। इसे बनाने में लगभग तीन साल लगे और लोग इस दिन की प्रतीक्षा कर रहे थे। उद्घाटन में महापौर ने भाषण दिया और कारीगरों को धन्यवाद दिया। पुस्तकालय में पढ़ने का कमरा, बच्चों का कमरा और एक छोटा कैफे है। किताबें दो सप्ताह के लिए घर ले जा सकते हैं।",
    "fi": "Tänä aamuna kaupungin keskustaan avattiin uusi kirjasto. Sen rakentaminen kesti melkein kolme vuotta, ja asukkaat olivat odottaneet tätä päivää pitkään. Avajaisissa puhui kaupunginjohtaja, joka kiitti arkkitehteja ja rakentajia. Kirjastossa on lukusali, lasten huone ja pieni kahvila. Kirjoja voi lainata kotiin kahdeksi viikoksi.",
    "ko": "오늘 아침 도시 중심에 새로운 도서관이 문을 열었다. 건설에는 거의 삼 년이 걸렸고, 주민들은 오랫동안 이 날을 기다려 왔다. 개관식에서 시장은 건축가와 노동자들에게 감사했다. 도서관에는 열람실과 어린이 방, 그리고 작은 카페가 있다. 책은 두 주 동안 빌릴 수 있다.",
    "th": "เช้าวันนี้ห้องสมุดแห่งใหม่เปิดให้บริการในใจกลางเมือง การก่อสร้างใช้เวลาเกือบสามปี และชาวเมืองรอคอยวันนี้มานาน นายกเทศมนตรีกล่าวขอบคุณสถาปนิกและคนงาน",
    "en": "This morning a new library opened in the middle of the town. It took almost three years to build, and people had been waiting for the day. The mayor spoke at the opening and thanked the architects and the workers. The library has a reading room, a room for children and a small café. Books can be taken home for two weeks.",
}


def test_clean_texts_of_other_scripts_are_kept(spark):
    scorer = q.learn(spark.createDataFrame(rows(), SCHEMA))
    score, _, votes = scorer.score(list(NEWS.values()))
    assert (score >= 0.5).all(), dict(zip(NEWS, score))
    assert all("0" not in v and v.count("1") >= 5 for v in votes), dict(zip(NEWS, votes))
    junk = [NEWS["ru"].upper().replace(" ", "!! "), "спам " * 200, " | ".join(NEWS["el"].split()), "的" * 300]
    assert (scorer.score(junk)[0] < 0.5).all()


def test_long_text_with_a_list_is_kept(spark):
    rng = random.Random(6)
    text = "\n".join(good(rng) for _ in range(20))
    listed = "\n".join(f"item {i} of the list" for i in range(60))
    scorer = q.learn(spark.createDataFrame(rows(), SCHEMA))
    assert (scorer.score([text, f"{text}\n{listed}\n{text}"])[0] >= 0.5).all()


def test_counts_code_points():
    a, b = (q.measure(t)[0] for t in ("aaaa bb. Cc dd", "éééé üü. Ññ öö"))
    assert (a.words, a.mean, a.short, a.ends) == (b.words, b.mean, b.short, b.ends) and a.upper == b.upper
    assert q.measure("今天早上。他来了！")[0].ends == 2 / 7 and q.measure("")[0].words == q.measure(" \n")[0].words == 0


def test_ties_at_the_threshold_are_kept(spark):
    table = spark.createDataFrame(rows(60), SCHEMA)
    got = {r.doc_id: r.score for r in q.classify(table).collect()}
    at = got[1]
    assert {r.doc_id for r in q.classify(table, threshold=at).filter("kept").collect()} == {i for i, x in got.items() if x >= at}


def test_rows_that_share_an_id_are_one_of_the_sample(spark):
    data = rows(60) + [(1, f"{rows(2)[1][1]} {i}.", "x", "x", 1) for i in range(300)]
    got = q.classify(spark.createDataFrame(data, SCHEMA), sample=50).collect()
    assert len(got) == 360 and sum(r.kept for r in got if r.doc_id == 1) == 301


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    seen = np.where(rng.random((20_000, 5)) < [0.95, 0.9, 0.9, 0.85, 0.95], truth[:, None], ~truth[:, None]).astype(int)
    patterns, counts = np.unique(seen, axis=0, return_counts=True)
    post = q.em([(tuple(map(int, p)), int(c)) for p, c in zip(patterns, counts)])
    guess = np.array([post[tuple(map(int, v))] > 0.5 for v in seen])
    assert (guess == truth).mean() > 0.97
    assert q.em([]) == {}
