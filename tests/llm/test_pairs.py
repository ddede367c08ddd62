import pytest
from conftest import rows

from quern.llm import pairs

FULL = "Người nộp hồ sơ phải ký nhận biên bản trong thời hạn 30 ngày kể từ ngày nhận đủ hồ sơ theo quy định. [Điều 5, Văn bản luat-1]"
Q = "Năm 1988 chú họ mua bến ghe riêng rộng 890 mét, còn giữ giấy ra trại; nay nên chờ hay nộp tại Đồng Nai?"
ANSWERS = [FULL, FULL.replace("30", "41"), FULL + " (xem thêm phụ lục kèm theo)", "**" + FULL + "**", FULL + "\n\n| Khu vực | m² |\n|---|---|\n| ấp | 3 m² |"] * 30 + ["Không.", "Cấp xã.", "41 ngày làm việc", "Không quá 85 m²"] * 5
CUT = [FULL[:60], FULL[:-12], FULL + " Sau 3 ngày làm việc tính từ ngày ký biên bản, người nhận nuôi và hộ gia"]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS + CUT], "answer string")
    return pairs.train_terminal(df, "answer")


@pytest.mark.parametrize("answer", [None, "", "  \u200b", "...", "—", "[]", "N/A", "null", "## Trả lời\n", "**Trả lời:**", "Trả lời:\n\n- \n- ", "# Bất kỳ đề mục"])
def test_empty(model, answer):
    assert pairs.defects(Q, answer, False, model) == ["empty"]


@pytest.mark.parametrize("answer", CUT)
def test_truncated(model, answer):
    assert pairs.defects(Q, answer, False, model) == ["truncated"]


@pytest.mark.parametrize("answer", ["Không.", "Cấp xã.", "41 ngày làm việc", "Không quá 85 m²", FULL, FULL + " (xem thêm phụ lục kèm theo)", "**" + FULL + "**"])
def test_complete(model, answer):
    assert pairs.defects(Q, answer, False, model) == []


def test_refusals(model):
    a = "Không tìm thấy căn cứ trong bộ văn bản hiện có. Mong bạn thông cảm."
    assert pairs.defects(Q, a, False, model) == ["refusal"] and pairs.defects(Q, a, True, model) == []
    assert pairs.defects(Q, "I cannot answer this question based on the material provided.", False, model) == ["refusal", "other_language"]
    assert pairs.defects(Q, "Tôi rất tiếc nhưng không thể hỗ trợ yêu cầu này. Bạn có thể đặt câu hỏi khác.", False, model) == ["refusal"]
    assert pairs.is_refusal("I'm sorry, but I can't help with that request.")
    partly = "Tôi không thể xác định mức phí cho từng hồ sơ, nhưng về trình tự thì có quy định như sau. " + FULL
    assert pairs.defects(Q, partly, False, model) == []


@pytest.mark.parametrize("answer", [Q, Q.upper(), f"“{Q}”", f"Trả lời: {Q[:-1]}", f"Câu hỏi: {Q}", f"{Q}\n{Q}", f"> **{Q}**", Q.replace(" ", "\u00a0", 3)])
def test_copies(model, answer):
    assert pairs.defects(Q, answer, False, model) == ["copies_question"]


def test_an_answer_that_repeats_the_question_first_is_no_copy(model):
    assert pairs.defects(Q, f"Về câu hỏi “{Q}” xin trả lời như sau:\n {FULL}", False, model) == []


def test_languages(model):
    en = "The applicant must keep the handover minutes if the plot exceeds 203 square metres."
    assert pairs.defects(Q, en, False, model) == ["other_language"]
    assert pairs.defects("What must the applicant keep if the plot is large?", en + " [Điều 42, Khoản 1, Văn bản nghi-dinh-306-2010]", False, model) == []
    assert pairs.defects(Q, f"Bản dịch ghi: “{en}” Nội dung này được hiểu như sau. " + FULL, False, model) == []
    assert pairs.language("Nguoi nop ho so phai ky nhan bien ban trong thoi han 30 ngay.") == "vi"
    assert pairs.language("申请人应在81天内提交土地边界图。") == "zh" and pairs.language("Опекун хранит копию акта.") == "ru" and pairs.language("Le voisin doit déposer la liste des surfaces.") == "fr"
    assert pairs.language("123 [Điều 5]") == "" and pairs.defects(None, FULL, False, model) == []


def test_frame(spark):
    df = spark.createDataFrame([(i, Q, a, None, 1) for i, a in enumerate(ANSWERS)] + [(900, None, None, None, 1), (901, Q, Q, "negative", 1), (901, Q, Q, "negative", 1)], "result_id long, question string, answer string, gap_type string, key int")
    assert rows(pairs.broken_pairs(df)) == [(900, "empty"), (901, "copies_question"), (901, "copies_question")]
    assert pairs.broken_pairs(df.limit(0)).count() == 0


def test_copies_of_any_length():
    q = lambda t: pairs.words(t)
    long = "Người thừa kế phải nộp hồ sơ gì tại xã khi sổ đã mất?"
    for question, answer in (("Ai nộp?", "Ai nộp"), ("Phí nào?", "Phí nào?"), ("Phí?", "phi"), (long, " ".join([long] * 5)), (long, " ".join([long] * 300)), (long, long.upper())):
        assert pairs.may_copy(q(question), answer) and pairs.copies(q(question), q(answer)), answer[:40]
    other = "Cơ quan tiếp nhận kiểm tra giấy tờ rồi hẹn ngày trả kết quả cho gia đình."
    for question, answer in (("Ai nộp?", "Cha nộp"), ("Ai nộp?", "Chủ đất"), (long, f"{long} {other}"), (long, other), (long, "hồ sơ gì"), (long, " ".join([long, *(f"điểm{i}" for i in range(9))]))):
        assert not (pairs.may_copy(q(question), answer) and pairs.copies(q(question), q(answer))), answer[:40]
    assert not pairs.copies([], []) and not pairs.copies(["a"], [])


def test_languages_beyond_those_of_the_tables():
    for name, text in (("it", "Il documento deve essere presentato entro il termine e non è più valido."), ("pt", "O requerimento deve ser entregue até ao fim do prazo e não pode ser alterado."), ("nl", "De aanvraag moet binnen de termijn worden ingediend en is niet geldig."), ("de", "Der Antrag muss bis zum Ende der Frist bei dem Amt sein."), ("pl", "Wniosek należy złożyć do urzędu i nie może być zmieniony, jak to jest w ustawie."), ("id", "Permohonan ini harus diajukan kepada kantor dan tidak dapat diubah.")):
        assert pairs.language(text) == name
    assert pairs.language("Hồ sơ đất đai") == "vi" and pairs.language("12/2024") == ""
