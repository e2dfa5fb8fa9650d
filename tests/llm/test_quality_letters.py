"""Scripts that write vowels as marks are letters too."""

from parcelgrid.llm import quality_rules

HINDI = (
    "भूमि की योजना बनाते समय सड़कों और भवनों के बीच पर्याप्त दूरी रखी जाती है ताकि हर भूखंड तक पहुँच बनी रहे। "
    "नगर निगम ने पिछले वर्ष नदी के किनारे एक नया उद्यान बनाया जिसमें बच्चों के खेलने की जगह भी है। "
    "किसान अपनी फसल मंडी में बेचते हैं और व्यापारी उसे दूसरे शहरों में भेजते हैं जहाँ उसकी मांग अधिक रहती है।"
)
THAI = (
    "การวางผังที่ดิน ต้องคำนึงถึงถนน และระยะห่าง ระหว่างอาคาร เพื่อให้ทุกแปลง เข้าถึงได้ น้ำประปา ไฟฟ้า ท่อระบายน้ำ "
    "ควรวางแผน ตั้งแต่เริ่มต้น ชาวบ้าน ริมแม่น้ำ ปลูกข้าว เลี้ยงปลา ขายผลไม้ ที่ตลาดเช้า เด็กนักเรียน เดินทางไป โรงเรียน "
    "ด้วยจักรยาน ครูใหญ่ เปิดห้องสมุด ทุกวันเสาร์ ฝนตกหนัก ในเดือนกันยายน ทำให้น้ำท่วม ถนนสายหลัก เจ้าหน้าที่ นำเรือ "
    "มาช่วยเหลือ ผู้สูงอายุ โรงพยาบาล เตรียมเตียง เพิ่มอีกสิบ ร้านค้า ปิดชั่วคราว สัปดาห์หน้า อากาศดีขึ้น พ่อค้า "
    "กลับมาเปิดร้าน นักท่องเที่ยว เริ่มจองที่พัก ชายทะเล ภูเขาเหนือ ปลายปีนี้ จังหวัด จัดงานวัด ประจำปี มีดนตรี และอาหาร"
)


def test_hindi_and_thai_are_kept_and_junk_is_not(spark):
    junk = " ".join(f"{k}-{k}.{k}%" for k in range(60))
    rows = spark.createDataFrame([(1, HINDI), (2, THAI), (3, junk)], "message_id int, content string")
    want = {1: True, 2: True, 3: False}
    assert dict(quality_rules.judge_messages(rows).collect()) == want
    assert {r.message_id: r.kept for r in quality_rules.measure_messages(rows).collect()} == want
    assert {r.message_id for r in quality_rules.keep_messages(rows).collect()} == {1, 2}
