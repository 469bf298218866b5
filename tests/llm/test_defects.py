import pytest

from corpusloom.llm import defects as D
from corpusloom.llm.language import LanguageModel
from corpusloom.session import table


@pytest.fixture(scope="module")
def judge(spark, data):
    return D.fit_judge(spark, data.replace("sf0.001", "sf0.01"))


P = "<audio>Put the speech into text."
MC = "<audio>Pick the right choice.\nQuestion: Which sound follows the scooter, a handpress or a documentary?\n(A) the rusty puddle\n(B) the soggy turnstile"


@pytest.mark.parametrize(
    "prompt,reply,want",
    [
        (P, None, "empty"), (P, "<think>\n\n</think>\n\n", "empty"), (P, "…", "empty"), (P, '{"answer": ""}', "empty"), (P, '{"answer": null}', "empty"), (P, "​", "empty"), (P, '""', "empty"),
        (MC, '{"answer": "D"}', None), (MC, '{"answer": "', "truncated"), (MC, '{"ans', "truncated"), (P, "Yes.", None), (P, "Twice", None),
        (P, "As a language model, I cannot listen to audio files.", "refusal"), (P, "Hello! I must decline to process this recording.", "refusal"), (P, "很抱歉，我无法完成这个要求。", "refusal"),
        (P, "sorry i cannot answer nine gentle hinge patiently yelled wynelan of maribury", None), (P, "i am unable to help oily vesobek said the mallet of tamaholm beeps raspily", None),
        (P, "PUT THE SPEECH INTO TEXT", "copied_question"), (P, "Put the speech into text. Put the speech into text.", "copied_question"),
        (MC, "which sound follows the scooter, a handpress or a documentary", "copied_question"), (MC, "A handpress", None), (P, "user: Put the speech into text.", "copied_question"), (P, "You ask: Put the speech into text. The lantern answers slowly near the harbour.", None),
        (P, "Close by, stern vineyard murmurs raspily against the", "truncated"), (P, "Im Hintergrund klappert ein Keller, danach folgt die nasse Trommel.", "other_language"),
        ("<audio>Turn the spoken words into German.", "Im Hintergrund klappert ein Keller, danach folgt die nasse Trommel.", None), (None, "Any reply that is long enough to be one.", None),
        ("请写下录音里说的话。", "我们听见河边的声音，", "truncated"), ("请写下录音里说的话。", "在码头旁边，一个安静的街道正在等待。", None),
    ],
)
def test_cases(judge, prompt, reply, want):
    assert judge.defect(prompt, reply) == want


def test_long_reply(judge):
    assert judge.defect(P, "The lantern answers slowly near the harbour. " * 20000) is None


def test_automaton():
    a = D.SuffixAutomaton("a b c a b d".split())
    assert a.runs("a b d x c a b".split()) == [1, 2, 3, 0, 1, 2, 3]
    assert D.open_delimiters('a "b') and not D.open_delimiters('(a) "b" “c”')


def test_few_rows_flagged(spark, data):
    n = table(spark, data, "train_samples").count()
    assert 0 < D.p5_found(spark, data).count() < 0.2 * n


def test_no_model():
    j = D.Judge(D.EndModel.fit([]), LanguageModel.fit([]))
    assert j.defect("a b c", "") == "empty" and j.defect("What is this thing?", "What is this thing?") == "copied_question"


TALK = "The lantern answers slowly near the harbour. "


@pytest.mark.parametrize(
    "reply,want",
    [
        ("I can't do what you asked.", True), ("I am unable to process this recording. " + TALK * 20, True), (TALK * 20 + "I am unable to process this recording.", True),
        (TALK * 10 + "I am unable to process this recording. " + TALK * 10, True), ("I cannot transcribe the clip. A man told a story in it.", True), ("很抱歉，我无法完成这个要求。" + "他在码头旁边等待一个安静的街道。" * 40, True),
        ('"I cannot answer that question." said the mallet.', False), ('The mallet said: "Sorry. I cannot answer that question."', False), (TALK * 20 + '"Sorry, I cannot," said the mallet. ' + TALK, False), (TALK * 200, False),
    ],
)
def test_refusal_of_any_length(reply, want):
    assert D.Judge(D.EndModel.fit([]), LanguageModel.fit([])).refusal(reply) == want


@pytest.mark.parametrize(
    "reply,want",
    [
        ("I am sorry, but I can't help with this request. " + "We follow rules that apply to all users here. " * 8, True), ("He said hello. I'm sorry, but I cannot transcribe this audio.", True),
        ("I must respectfully pass on describing the people in this clip.", True), ("As an AI model I do not provide medical diagnoses from recordings.", True),
        ("My rules do not permit me to judge this recording.", True), ("Diese Frage kann ich aus guten Gründen nicht beantworten.", True), ("Ma politique ne me permet pas de décrire cet enregistrement.", True),
        ("No me está permitido describir esta grabación.", True), ("我不被允许，所以无法评论这段录音。", True), ("この録音について意見を述べることはできません。", True),
        ("The recording isn't loud and the voice is calm.", False), ("I cannot find my boots near the river, they said.", False), ("Nobody in the clip answers the question.", False), ("她不会在市场上说话。", False),
        ("a man says that it is not possible to see the harbour", False), ("I have a question about the recording.", False),
    ],
)
def test_refusals_in_words_of_their_own(reply, want):
    assert D.Judge(D.EndModel.fit([]), LanguageModel.fit([])).refusal(reply) == want


def test_language_of_a_json_reply(judge):
    assert judge.defect(P, '{"answer": "Im Hintergrund klappert ein Keller, danach folgt die nasse Trommel."}') == "other_language"


def test_words_of_all_replies(spark):
    """The fragment test doesn't depend on the size: fragments at cuts are no words, however often they occur."""
    for size in (30, 3000):
        replies = [("The harbour is quiet.",), ("A lantern in the harbour hums.",), ("We hear the harb",)] * size
        words, _ = D.known_words(spark.createDataFrame([*replies, (None,)], "r string"), len(replies))
        assert {"harbour", "lantern", "hums"} <= set(words) and D.EndModel.fit([], words=(words, set())).is_fragment("harb")
