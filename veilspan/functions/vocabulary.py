"""Fixed values of the Thai personal-data domain: patterns, cue words, windows and name lists.

They define the results, so they stand here together, in natural order; what is done with them is elsewhere.
"""

from __future__ import annotations

import re

I = re.IGNORECASE

# --- shapes of values (group 1 is the value) -------------------------------------------------------------------------------------
MONTHS = "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม".split()
SHAPES: dict[str, str] = {
    "thai_id": r"(?<!\d)(\d[-\s]?\d{4}[-\s]?\d{5}[-\s]?\d{2}[-\s]?\d)(?!\d)",
    "card": r"(?<!\d)(\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4})(?!\d)",
    "iban": r"\b([A-Z]{2}\d{2}[A-Z0-9]{11,30})\b",
    "email": r"(?<![a-zA-Z0-9._%+\-])([a-zA-Z0-9][a-zA-Z0-9._%+\-]*@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})(?![a-zA-Z0-9\-])",
    "mobile": r"(?<!\d)(0[- ]?[6-9]\d[-\s]?\d{3}[-\s]?\d{4})(?!\d)",
    "landline": r"(?<!\d)(0[- ]?(?:2[-\s]?\d{3}[-\s]?\d{4}|[3-7]\d[-\s]?\d{3}[-\s]?\d{3}))(?!\d)",
    "plus66": r"(?<![a-zA-Z0-9_])(\+66[-\s]?\d(?:[-\s]?\d){7,8})(?!\d)",
    "account_4": r"(?<!\d)(\d{3}[-\s]?\d[-\s]?\d{5}[-\s]?\d)(?!\d)",
    "account_2": r"(?<!\d)(\d{7}[-\s]?\d{3})(?!\d)",
    "date": r"(?<!\d)(\d{1,2}[/\-]\d{1,2}[/\-](?:\d{4}|\d{2})|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})(?!\d)",
    "month_date": r"(?<!\d)(\d{1,2} (?:" + "|".join(MONTHS) + r") (?:พ\.?ศ\.? ?)?\d{4})(?!\d)",
    "plate": r"([ก-ฮ]{1,3}\s*\d{1,4})(?!\d)",
    "passport_th": r"(?<![A-Za-z0-9_])([A-Z]{2}\d{7})(?![A-Za-z0-9_])",
    "passport": r"(?<![A-Za-z0-9_])([A-Z]{1,2}\d{6,9})(?![A-Za-z0-9_])",
    "long_digits": r"(?<!\d)(\d{8,12})(?!\d)",
    "dashed_student": r"(?<!\d)(\d{2}-\d{2}-\d{4})(?!\d)",
    "house": r"(?:บ้านเลขที่|เลขที่|ทะเบียนบ้าน|ที่อยู่(?:ปัจจุบัน|ตามทะเบียนบ้าน|ที่ติดต่อได้)?|สถานที่เช่า|ที่ตั้งสำนักงานใหญ่)\s*[:：]?\s*(\d{1,4}(?:\s*[/-]\s*\d{1,4})?)(?!\d)",
    "house_street": r"(?<!\d)(\d{1,4}(?:\s*[/-]\s*\d{1,4})?)\s+(?=(?:ถนน|ถ\.|ซอย|ซ\.|ตรอก))",
    "house_building": r"(?<!\d)(\d{1,4}\s*/\s*\d{1,4})\s+(?=(?:คอนโด|อาคาร|หมู่บ้าน|ตึก|นิคม|หมู่))",
    "street": r"(?:ซอย|ซ\.|ถนน|ถ\.)\s*([ก-๛A-Za-z0-9]+(?:\s*\d{1,4})?)(?!\d)",
    "estate": r"นิคมอุตสาหกรรม\s*(?!แห่งประเทศไทย)([ก-๛A-Za-z0-9]+)",
    "moo": r"(?:หมู่ที่|หมู่|ม\.)\s*(\d{1,3})(?!\d)",
    "area": r"(?:แขวง|ตำบล|ต\.|(?<!นาย)(?<!ปลัด)(?<!รอง)(?<!ท่าน)(?:อำเภอ|เขต(?!บริการ|พื้นที่))|อ\.|จังหวัด|จ\.)\s*([ก-๛]{2,})",
    "postal": r"(?<!\d)(\d{5})(?!\d)",
    "hospital": r"(?<![A-Za-z])(?:HN|เวชระเบียน|ผู้ป่วยเลขที่)\s*[:：]?\s*(\d{4,9})(?!\d)",
    "any_13_digits": r"(?<!\d)(\d{13})(?!\d)",
    "any_email": r"([^\s@]+@[^\s@]+\.[^\s@]{2,})",
    "any_date": r"(?<!\d)(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})(?!\d)",
    "damaged_id": r"(?<![0-9+$#])([0-9+$#]+)(?![0-9+$#])",
}
SHAPE = {k: re.compile(v, I if k == "hospital" else 0) for k, v in SHAPES.items()}
PROVINCES = (
    "กระบี่ กรุงเทพมหานคร กาญจนบุรี กาฬสินธุ์ กำแพงเพชร ขอนแก่น จันทบุรี ฉะเชิงเทรา ชลบุรี ชัยนาท ชัยภูมิ ชุมพร เชียงราย เชียงใหม่ ตรัง ตราด ตาก นครนายก นครปฐม นครพนม "
    "นครราชสีมา นครศรีธรรมราช นครสวรรค์ นนทบุรี นราธิวาส น่าน บึงกาฬ บุรีรัมย์ ปทุมธานี ประจวบคีรีขันธ์ ปราจีนบุรี ปัตตานี พระนครศรีอยุธยา พะเยา พังงา พัทลุง พิจิตร พิษณุโลก เพชรบุรี "
    "เพชรบูรณ์ แพร่ ภูเก็ต มหาสารคาม มุกดาหาร แม่ฮ่องสอน ยโสธร ยะลา ร้อยเอ็ด ระนอง ระยอง ราชบุรี ลพบุรี ลำปาง ลำพูน เลย ศรีสะเกษ สกลนคร สงขลา สตูล สมุทรปราการ "
    "สมุทรสงคราม สมุทรสาคร สระแก้ว สระบุรี สิงห์บุรี สุโขทัย สุพรรณบุรี สุราษฎร์ธานี สุรินทร์ หนองคาย หนองบัวลำภู อ่างทอง อำนาจเจริญ อุดรธานี อุตรดิตถ์ อุทัยธานี อุบลราชธานี"
).split()
PROVINCE = re.compile("(" + "|".join(sorted(PROVINCES, key=len, reverse=True)) + ")")

# --- cues: words that decide what a number is ------------------------------------------------------------------------------------
CUES: dict[str, str] = {
    "bank": r"บัญชี|ธนาคาร",
    "phone": r"โทรศัพท์|โทร|เบอร์|มือถือ|ติดต่อ",
    "birth": r"(?<!เหตุ)เกิด(?!เหตุ)|date of birth|\bd\.?o\.?b\b",
    "postal": r"รหัสไปรษณีย์|จังหวัด|แขวง|ตำบล|อำเภอ|เขต(?!บริการ)|กรุงเทพ|ที่อยู่",
    "pupil": r"รหัสนักศึกษา|รหัสนิสิต|นักศึกษา|นิสิต|นักเรียน|ผู้เรียน|student",
    "not_pupil": r"รหัส(?:ราย)?วิชา|รหัสหลักสูตร|รหัสเอกสาร|รหัสพนักงาน|รหัสอ้างอิง|รหัสชำระ|รหัสสินค้า|รหัสรายการ|รหัสสั่งซื้อ|รหัสโครงการ|รหัสครุภัณฑ์|รหัสผ่าน",
    "id_word": r"รหัสประจำตัว|เลขประจำตัว|รหัส|\bid\b",
    "education": r"นักศึกษา|นิสิต|นักเรียน|ผู้เรียน|student|ลงทะเบียนเรียน|ภาคเรียน|สหกิจศึกษา|หน่วยกิต|ขาดเรียน|ค่าเทอม|สำเร็จการศึกษา|อาจารย์ที่ปรึกษา|ชั้นปี|เกรดเฉลี่ย",
    "commerce": r"ราคา|ยอด|จำนวนเงิน|ใบเสร็จ|ใบแจ้งหนี้|ใบกำกับ|สินค้า|สั่งซื้อ|คำสั่งซื้อ|ออเดอร์|invoice|order",
    "passport": r"พาสปอร์ต|หนังสือเดินทาง|passport",
    "organisation": r"เลขที่โครงการ|ISSN|คำขอรับสิทธิบัตร|สิทธิบัตรเลขที่",
    "amount": r"ราคา|ยอด|จำนวนเงิน|ใบเสร็จ|ใบแจ้งหนี้|ใบกำกับ|สินค้า|สั่งซื้อ|คำสั่งซื้อ|ออเดอร์|invoice|order|รวม|บาท|total",
    "id_card": r"รหัสประจำตัว|เลขประจำตัว|รหัส|\bid\b|เลขที่บัตรประชาชน|เลขบัตรประชาชน|เลขประจำตัวประชาชน|บัตรประชาชน|เลขที่บัตร|เลขบัตร|เลขประชาชน|national id",
    "student_label": r"(?:รหัส|เลขประจำตัว)(?:นักศึกษา|นิสิต|นักเรียน)",
    "registration": r"ทะเบียน",
    "registration_label": r"ทะเบียน(?:รถ(?:ยนต์|จักรยานยนต์)?)?",
    "year": r"(?:ปี(?:งบประมาณ|ภาษี)?|พ\.?\s*ศ\.?)\s*$",
    "code_prefix": r"(?:PO|RC|TX|SKU|ITM)-\Z",
}
CUE = {k: re.compile(v, I) for k, v in CUES.items()}
CIVIL_REGISTERS = ("บ้าน", "สมรส", "ราษฎร", "หย่า")
NEVER_PLATES = frozenset(("ซอย", "ถนน"))
MINISTRIES = frozenset("ศธ กค มท นร สธ กษ ตช อว คค ทส พณ รง วธ พม ยธ ดศ กต กห ปช".split())
AMOUNT_WORDS = frozenset(("ยอด", "ออก", "รวม"))

# --- how far cues are looked for, in characters ----------------------------------------------------------------------------------
NEAR, PUPIL_BEFORE, PUPIL_AFTER, INTRO, EDUCATION, PLATE, CODE, POSTAL, POSTAL_GAP, PROVINCE_GAP, SIBLING, DAMAGED, LABEL = 30, 60, 45, 20, 100, 15, 12, 45, 25, 20, 40, 40, 25

# --- addresses -------------------------------------------------------------------------------------------------------------------
ADDRESS_GLUE = r"ตำบล|อำเภอ|จังหวัด|แขวง|เขต|หมู่ที่|หมู่|ซอย|ถนน|ต\.|อ\.|จ\.|ม\.|อาคาร|หมู่บ้าน|ตึก|ชั้น|ห้อง|คอนโด|ตรอก|แยก|นิคม"
ADDRESS_VETO = r"บ้านเลขที่|ที่อยู่|เลขที่|ผู้ซื้อ|ผู้ขาย|ผู้กู้|ผู้ค้ำ|ผู้เช่า|ผู้ให้เช่า|ส่งที่|ติดต่อ|นาย|นาง|นางสาว"
FACILITY = r"(?:ห้องประชุม|ห้องเรียน|ห้อง|อาคาร|ตึก|ชั้น)\s*\d+"
BOOKING = r"ความจุ|ที่นั่ง|จอง|ประชุม|อบรม|สัมมนา|บรรยาย|ห้องสอบ|สนามสอบ|ตารางสอบ|ผู้เข้าสอบ"

# --- risk ------------------------------------------------------------------------------------------------------------------------
QUASI: dict[str, str] = {
    "gender": r"(?:นาย|นาง(?:สาว)?|ด\.ช\.|ด\.ญ\.)\s*[\p{L}\p{N}_]",
    "date_of_birth": r"(?<![\p{L}\p{N}_])(?:\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}-\d{2}-\d{2})(?![\p{L}\p{N}_])",
    "age": r"(?:อายุ\s*\d+\s*ปี|\d+\s*ขวบ)",
    "district": r"(?:แขวง|ตำบล)\s*[\p{L}\p{N}_]",
    "province": r"(?:จังหวัด|จ\.)\s*[\p{L}\p{N}_]",
    "occupation": r"(?:อาชีพ|ทำงาน(?:เป็น)?|ประกอบอาชีพ)\s*[\p{L}\p{N}_]",
    "religion": r"(?:ศาสนา|พุทธ|คริสต์|อิสลาม|ฮินดู|ซิกข์)",
}
SECTION26: dict[str, str] = {
    "RACE_ETHNICITY": r"(?:เชื้อชาติ|เผ่าพันธุ์|สัญชาติ)",
    "POLITICAL_OPINION": r"(?:ความคิดเห็นทางการเมือง|พรรคการเมือง|อุดมการณ์)",
    "RELIGION": r"(?:ศาสนา|ความเชื่อ|พุทธ|คริสต์|อิสลาม|ฮินดู)",
    "HEALTH": r"(?:โรค|การรักษา|ผล(?:การ)?ตรวจ|สุขภาพ|ประวัติ(?:การ)?รักษา)",
    "SEXUAL_BEHAVIOR": r"(?:เพศ(?:สัมพันธ์|วิถี)|รสนิยมทางเพศ)",
    "CRIMINAL_RECORD": r"(?:คดี|ต้องโทษ|จำคุก|ประวัติอาชญากรรม|ถูกฟ้อง)",
    "DISABILITY": r"(?:ทุพพลภาพ|ความพิการ|คนพิการ)",
    "LABOR_UNION": r"(?:สหภาพแรงงาน|สมาคมลูกจ้าง)",
}
STRONG_TYPES = ("THAI_ID", "PASSPORT", "PHONE", "EMAIL")
TITLES = r"^(?:นางสาว|นาย|นาง|ด\.ช\.|ด\.ญ\.|เด็กชาย|เด็กหญิง|Mr\.?|Mrs\.?|Ms\.?|Miss)\s*"

# --- tokens ----------------------------------------------------------------------------------------------------------------------
TOKEN_LABELS: dict[str, str] = {
    "NAME": "ชื่อ", "SURNAME": "นามสกุล", "THAI_ID": "บัตรประชาชน", "PHONE": "โทรศัพท์", "EMAIL": "อีเมล", "ADDRESS": "ที่อยู่", "POSTAL_CODE": "รหัสไปรษณีย์",
    "MEDICAL_ID": "เลขเวชระเบียน", "BANK_ACCOUNT": "บัญชีธนาคาร", "CREDIT_CARD": "บัตรเครดิต", "DATE_OF_BIRTH": "วันเกิด", "PASSPORT": "พาสปอร์ต", "STUDENT_ID": "รหัสนักศึกษา",
    "VEHICLE_PLATE": "ทะเบียนรถ", "IBAN": "ไอแบน", "LOCATION": "สถานที่", "DATE": "วันที่", "ORGANIZATION": "องค์กร", "ID_NUMBER": "รหัสอ้างอิง",
}
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"

# --- prompt injection (category, severity, pattern) ------------------------------------------------------------------------------
HIDDEN = "[​‌‍﻿‪-‮⁦-⁩]"
_MARK = r"(?:dan|unrestricted|unfiltered|jailbroken|evil)"
INJECTION: tuple[tuple[str, str, str], ...] = (
    ("hidden_chars", "medium", HIDDEN),
    ("instruction_override", "high", r"(?:ลืม|ยกเลิก|ไม่ต้องสนใจ|ไม่สนใจ|เพิกเฉยต่อ)(?:คำสั่ง|กติกา|ข้อกำหนด)(?:ก่อนหน้า|ที่ผ่านมา|ที่ให้ไว้|ที่สั่งไว้|ที่บอกไว้|ทั้งหมด)|ignore (?:all |the )?(?:previous|prior|above) instruction|disregard (?:all |the )?(?:previous|prior|above)|forget (?:everything|all|your) (?:above|instruction|rule)"),
    ("role_hijack", "medium", rf"\bact as (?:an? )?{_MARK}\b|\byou are now (?:(?:an? )?{_MARK}|in (?:dan|developer) mode)\b|\bpretend (?:to be|you are) (?:an? )?{_MARK}\b|\bfrom now on,? you are (?:an? )?{_MARK}\b|\bignore your (?:role|persona)\b|คุณคือ.{{0,20}}(?:ไม่มีข้อจำกัด|ไม่มีขีดจำกัด)|สวมบทเป็น.{{0,20}}(?:ไม่มีข้อจำกัด|ไม่มีขีดจำกัด|ปลดล็อก|ทำได้ทุกอย่าง|dan)"),
    ("exfiltration", "high", r"\b(?:reveal|print|output|repeat|leak|dump|show|tell|give|share|disclose|what(?:'s|\s+is)|write\s+out)\b.{0,40}\b(?:system|hidden)\s+(?:prompt|instruction)s?\b|(?:แสดง|เปิดเผย|พิมพ์|บอก|ขอดู|ขอ).{0,40}ตารางจับคู่โทเคน"),
    ("suspicious_payload", "low", r"[A-Za-z0-9+/=]{120,}"),
)

# --- names -----------------------------------------------------------------------------------------------------------------------
TITLE_WORDS = ("นาย", "นางสาว", "นาง", "น.ส.", "ด.ช.", "ด.ญ.", "เด็กชาย", "เด็กหญิง")
INTRODUCTIONS = ("ผมชื่อ", "ดิฉันชื่อ", "ฉันชื่อ", "หนูชื่อ", "กระผมชื่อ", "ข้าพเจ้าชื่อ", "ลงชื่อ", "ข้าพเจ้า")
NOT_NAMES = frozenset(
    """ชื่อ นามสกุล คือ ครับ ค่ะ คะ นะ และ ที่ ของ จาก อยู่ เป็น อายุ มา ไป ได้ เบอร์ อีเมล โทร เลข หมายเลข บัตร บัตรประชาชน เลขบัตรประชาชน ประชาชน รหัส รหัสพนักงาน พนักงาน บัญชี เลขบัญชี เลขที่บัญชี
    ธนาคาร โทรศัพท์ มือถือ ที่อยู่ ทะเบียน เอกสาร เลขที่ หนังสือเดินทาง ลายมือชื่อ รายการ เงื่อนไข เลขประจำตัว ตำแหน่ง อาชีพ ขอแสดงความนับถือ เรียน วันเกิด ความสัมพันธ์ ประจำตัว""".split()
)
NAME_STOPS = frozenset("ต้อง ควร จะ ให้ โปรด กรุณา สามารถ ขอ กรอก แนบ แสดง ชำระ ดำเนิน ดำเนินการ ยอมรับ ได้ ได้รับ รับ อยู่ เป็น คือ ประสงค์ ทุก ราย ท่าน".split())
ACCOUNT_KINDS = frozenset("ออมทรัพย์ กระแสรายวัน ฝากประจำ".split())
ORGANISATION_LEADS = tuple("บริษัท ห้าง ธนาคาร โรงพยาบาล มหาวิทยาลัย โรงเรียน สำนักงาน โรงงาน มูลนิธิ โครงการ สมาคม สหกรณ์ หน่วยงาน หจก บจก".split())
ROLES: dict[str, str] = {  # a role, and what may not follow it at once
    "ผู้ค้ำประกันเงินกู้": "ต้อง ควร มี ร่วม", "ผู้รับมอบอำนาจ": "ต้อง ควร ช่วง", "ผู้รับการตรวจ": "ต้อง ควร", "ผู้ยื่นอุทธรณ์": "ต้อง ควร", "ผู้ยื่นคำร้อง": "ต้อง ควร", "ผู้ค้ำประกัน": "ต้อง ควร มี ร่วม",
    "ผู้เอาประกันภัย": "ต้อง ควร", "ผู้เสียหาย": "ต้อง ควร ได้ แจ้ง ถูก มี ให้ ไม่ จะ ทั้ง", "ผู้ปกครอง": "ต้อง ควร ของ นักเรียน และ", "ผู้สั่งซื้อ": "สินค้า ต้อง ควร", "ผู้ถือบัตร": "ต้อง ควร สามารถ ทุก",
    "ผู้เดินทาง": "ต้อง ควร ทุก ที่", "ผู้ขับขี่": "ต้อง ควร ที่ ทุก", "ผู้ติดต่อกรณีฉุกเฉิน": "ต้อง ควร ติดต่อ โทร ได้ แจ้ง", "ผู้ติดต่อ": "หลัก สำรอง สอบถาม กลับ ได้ ประสาน กรณี", "ผู้สมัคร": "งาน สอบ ทุก ที่ สามารถ รหัส",
    "ผู้แจ้ง": "ความ เบาะแส เตือน", "ผู้ยื่น": "ภาษี แบบ", "ผู้ป่วย": "ใน นอก ราย ทุก ต้อง ควร ที่ จะ ได้ เรื้อรัง", "ผู้กู้": "ร่วม ยืม ต้อง ควร", "มอบอำนาจให้": "", "ออกให้": "", "ชื่อบัญชี": "ผู้ใช้",
}
SPACED_ROLES = frozenset(("มอบอำนาจให้", "ออกให้"))  # count only with a space after them
ROLE_LINKS, ROLE_KINDS = ("คือ", "ชื่อ", "ได้แก่"), ("หญิง", "ชาย")
NAME_LABELS: dict[str, str] = {
    "line": r"(?m)^[ \t]*ชื่อ(?:-นามสกุล)?(?:[ \t:：]+|[ \t:：]*\r?\n)",
    "inline": r"(?:สัญชาติ|คำนำหน้า|เพศ)[^\r\n]{0,30}?(?<![ก-๛])ชื่อ(?:-นามสกุล)?[ \t:：]+",
    "kin": r"(?:คุณแม่|คุณพ่อ|แม่|พ่อ|พี่สาว|พี่ชาย|พี่|น้องสาว|น้องชาย|น้อง|ลูกสาว|ลูก|ภรรยา|สามี|ป้า|ลุง|ย่า|ยาย|ปู่|ตา|หลาน|เพื่อน|แฟน)ชื่อ[ \t:：]*",
    "roster": r"(?m)(?:^|(?<=\s))(?:ลำดับที่[ \t]*\d+[ \t.]*|\d{1,3}\.[ \t]+)",
    "latin": r"(?:Name|ชื่อ)[ \t]*[:：=][ \t]*|(?:Name|ชื่อ)[ \t]+|contact person[ \t:：]*|(?:Mrs|Ms|Mr)\.?[ \t]+|ผู้ยื่น[ \t]+|ผู้แจ้ง[ \t]+|ที่นั่งสอบ[ \t]*[A-Za-z]?\d+[ \t]+",
}
ROSTER_HEADER = r"รายชื่อ|ผู้เข้าสอบ|ผู้เข้าพัก|ผู้มีสิทธิ์|ผู้ผ่านการ|ทะเบียนผู้|ผลการคัดเลือก|ผู้มาประชุม|ผู้เข้าร่วมประชุม"
BEFORE_PASSPORT = r"(?<![ก-๛])([ก-๛]{2,25}[ \t][ก-๛]{2,25})[ \t]+(?=passport|[A-Z]{2}\d{7})"
LATIN_NAME = r"[A-Z][a-z]{1,20}(?:[ \t](?:[A-Z]\.|[A-Z][a-z]{1,20})){1,3}"
NOT_LATIN_NAMES = frozenset("bank company limited public hospital university hotel road river province district tower office department faculty school service customer group branch building resort airport station palace temple market mall co ltd plc".split())
DOCUMENT_HEADS = r"รายชื่อ|หนังสือ|ใบรับรอง|ใบสมัคร|ใบเสร็จ|แบบฟอร์ม|แบบคำขอ|เอกสาร|ตาราง|บันทึก|ประกาศ|สำเนา|ทะเบียน"
NAME_CUE_ON_NEXT_LINE = r"(?:นาย|นางสาว|นาง|น\.ส\.|ด\.ช\.|ด\.ญ\.|เด็กชาย|เด็กหญิง|ชื่อ)"

# A form's line of a second applicant ("and", or how it is misread; marks; a name), and what such a name does not begin with.
CO_APPLICANT = r"(?m)^[ \t]*(?:และ|แถะ)[^ก-๛\r\n]{2,}([ก-๛]{4,25}(?:[ \t]+[ก-๛]{2,25})?)[ \t]*$"
CO_APPLICANT_STOPS = ("กรอก", "ขอ", "คำ", "บริษัท", "ผู้", "มูลนิธิ", "เอกสาร", "โรงงาน", "โครงการ")
CO_APPLICANT_LIKENESS = 0.8
