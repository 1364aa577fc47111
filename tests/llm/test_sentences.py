import random

import pytest

from sigloom.llm import sentences as S

TEXTS = {
    "Dr. Ostrel saw it. The U.S. unit (cf. Fig. 6b) held for 9 min. Really?! Yes.": ["Dr. Ostrel saw it.", "The U.S. unit (cf. Fig. 6b) held for 9 min.", "Really?!", "Yes."],
    'She wrote "Stop here. It is late." in the margin. "Was it old?" asked Prof. Abel. He said: "No!" Then it ended.': ['She wrote "Stop here. It is late." in the margin.', '"Was it old?" asked Prof. Abel.', 'He said: "No!"', "Then it ended."],
    "The file block_59.v2.csv has 13.87 dB at 3 p.m. Next came no. 5.": ["The file block_59.v2.csv has 13.87 dB at 3 p.m.", "Next came no. 5."],
    "1. Quel bruit !\n2. « Arrêtez tout. Le son est en retard. » a noté Mme X.\n3. Fin.": ["1. Quel bruit !", "2. « Arrêtez tout. Le son est en retard. » a noté Mme X.", "3. Fin."],
    "Notes for block 9\n \nchannel check\r\n\r\nit was\nwrapped here.": ["Notes for block 9", "channel check", "it was\nwrapped here."],
    "Die Pause kam erst im 2. Durchgang vor. Am 3. Mai endete Lauf 9. Laut Dr. med. Abel, d. h. etwa 5 % usw. geprüft.": ["Die Pause kam erst im 2. Durchgang vor.", "Am 3. Mai endete Lauf 9.", "Laut Dr. med. Abel, d. h. etwa 5 % usw. geprüft."],
    "「止めてください。音が遅れています。」と担当者が記録した。被験者は「新しい曲だ」と答えた。": ["「止めてください。音が遅れています。」と担当者が記録した。", "被験者は「新しい曲だ」と答えた。"],
    "记录员写道：“请停一下。声音晚了。”为什么这么安静？“旋律是新的！”技师说。信号……又回来了。": ["记录员写道：“请停一下。声音晚了。”", "为什么这么安静？", "“旋律是新的！”技师说。", "信号……又回来了。"],
    "Γιατί μένει επίπεδο; Τι θόρυβος! Ο δρ. Velmar έπαιξε.": ["Γιατί μένει επίπεδο;", "Τι θόρυβος!", "Ο δρ. Velmar έπαιξε."],
    "Мы убрали ок. 42 проб, т. е. 5,55 %. См. рис. 80. Проверили гнёзда и т. д. Тон пришёл!": ["Мы убрали ок. 42 проб, т. е. 5,55 %.", "См. рис. 80.", "Проверили гнёзда и т. д.", "Тон пришёл!"],
    "ขั้วไฟฟ้า 59 ตอบสนองช้า ค่าเฉลี่ยของคอร์ดคือ 17.21 เดซิเบล ไฟล์ tone.48.wav ว่างเปล่า": ["ขั้วไฟฟ้า 59 ตอบสนองช้า", "ค่าเฉลี่ยของคอร์ดคือ 17.21 เดซิเบล", "ไฟล์ tone.48.wav ว่างเปล่า"],
    "هل كان معروفاً؟ قال المساعد: «جديد!» الملف فارغ.": ["هل كان معروفاً؟", "قال المساعد: «جديد!»", "الملف فارغ."],
    "ዜማው 7.58 ሰከንድ ቆየ። መስመር 26 ለምን ጸጥ አለ? ድምፁ ዘገየ።": ["ዜማው 7.58 ሰከንድ ቆየ።", "መስመር 26 ለምን ጸጥ አለ?", "ድምፁ ዘገየ።"],
    "Ձայնը ուշացավ։ Ինչո՞ւ է ալիք 89 լուռ։": ["Ձայնը ուշացավ։", "Ինչո՞ւ է ալիք 89 լուռ։"],
    "क्या सुर था? डॉ. X ने चलाया। \"सुर नया है।\" तकनीशियन ने कहा।": ["क्या सुर था?", "डॉ. X ने चलाया।", "\"सुर नया है।\" तकनीशियन ने कहा।"],
    "噪声太大！Room 5 was strong.信号又回来了。It clips.J. K. Abel et al. reported it.": ["噪声太大！", "Room 5 was strong.", "信号又回来了。", "It clips.", "J. K. Abel et al. reported it."],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def weights(docs):
    return S.fit(docs.where("doc_id % 3 <> 0"), "doc_id", "text", 5000)


@pytest.mark.parametrize("text", list(TEXTS))
def test_texts(weights, text):
    """Texts split by hand."""
    assert [text[a:b] for a, b in S.sentence_spans(text, S.Potentials(weights))] == TEXTS[text]


def test_held_out_accuracy(docs, weights):
    """On texts it wasn't trained on, the model gives the labels that those texts' own paragraphs give."""
    rows = docs.where("doc_id % 3 = 0 and text <> ''").collect()
    texts = [S.places(r.text) for r in rows]
    labels = S.weak_labels(texts, [S.right_word(r.text, 0) for r in rows])
    model = S.Potentials(weights)
    bad = n = 0
    for ps, want in zip(texts, labels):
        got = S.viterbi(ps, [model.of(p) for p in ps])
        bad += sum(a != b for a, b in zip(got, want))
        n += len(ps)
    assert n > 50_000 and bad / n < 0.005


def test_labels_need_no_lists():
    """A made-up abbreviation is learned from where it stands: before capitals, and never at a paragraph's end."""
    rng = random.Random(0)
    kinds = ["The qx. Abel saw it.", "Then it rained.", "Abel spoke at noon.", "Every one left!", "Was it 3.5 or 4?", "Lund went on."]
    texts = ["\n\n".join(" ".join(rng.choices(kinds, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    ps = [S.places(t) for t in texts]
    labels = S.weak_labels(ps, [S.right_word(t, 0) for t in texts])
    for t, places, tags in zip(texts, ps, labels):
        ends = [p.end for p, l in zip(places, tags) if l and not p.sure]
        assert len(ends) == sum(t.count(k) for k in kinds)
    w = S.train(ps, labels)
    new = "The qx. Brun saw it. Lund spoke at 4.75 volts. Every one left!"
    assert [new[a:b] for a, b in S.sentence_spans(new, S.Potentials(w))] == ["The qx. Brun saw it.", "Lund spoke at 4.75 volts.", "Every one left!"]


def test_thai_is_learned_from_neighbouring_letters(weights):
    """Without any mark: blanks between Thai letters part sentences, blanks beside digits and other letters don't."""
    model = S.Potentials(weights)
    text = "เสียงดังเกินไป ไฟล์ tone ว่าง ขั้ว 59 ช้า"
    places = [p for p in S.places(text) if p.obs[0] == "thai"]
    assert len(places) == 6 and len({tuple(S._features(p)) for p in places}) > 3
    assert [text[a:b] for a, b in S.sentence_spans(text, model)] == ["เสียงดังเกินไป", "ไฟล์ tone ว่าง", "ขั้ว 59 ช้า"]


def test_unpunctuated_training_ignores_marks():
    assert S.strip_thai_marks("เสียงดัง. ต่อไป") == "เสียงดัง ต่อไป"


def test_cover_and_edges(spark, weights):
    rows = [(1, " a.  B!\n\n c", 1), (2, None, 1), (3, "", 1), (4, " \n\t ", 1), (5, "word. " * 40000, 1), (6, "x", 1), (6, "x", 1), (7, "​First. ⁠Second\U0001d11e.", 1), (None, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, d int")
    got = S.split_sentences(df, "doc_id", "text", weights).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.sent_no, r.start_char, r.end_char))
    assert set(by) == {1, 5, 6, 7} and len(by[5]) == 40000 and sorted(by[6]) == [(1, 0, 1)] * 2
    for i, t, _ in rows:
        if i in (1, 5, 7):
            spans = sorted(by[i])
            assert [s for s, _, _ in spans] == list(range(1, len(spans) + 1))
            left = list(t)
            for _, a, b in spans:
                assert a < b and not t[a].isspace() and not t[b - 1].isspace()
                left[a:b] = " " * (b - a)
            assert not "".join(left).strip()
    assert S.split_sentences(df.limit(0), "doc_id", "text", weights).count() == 0
