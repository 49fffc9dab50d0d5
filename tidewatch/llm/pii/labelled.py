"""Texts with known spans, for training and for holding out: written sentences with invented private data in their slots.

A slot is <kind>, everything between two slots is ordinary. Names are built from syllables, so that no list of names is learnt.
"""

from __future__ import annotations

import random
import re

SYLLABLES = "al ar bel bran cor da del dor el en fa fen gar gel hal har il in ja jo ka kel la lan lo mar mel mi mo na nel nor o or pa per qui ra ren ro sa sel si sol ta tam tel to u va vel vi wen wil ya ys zo".split()
ENDS = "a e o an en in on is us mar ra na la ne wyn bert ric ton ley man son berg ski stad ova etti quist gard mosk bane down moor neath tarsky warrow velli anen ovar grin sley".split()
HANGUL_NAMES = "김이박최정강조윤장임한오서신권황안송류홍전고문손배백허유남심노하곽성차주우구민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용"
HANGUL_GIVEN = "가강건결경고규나다담라람린명미민별보빈빛상새서선솔수슬승아안연영예온우원유윤율은이인재정조주준지진찬채태하한해현혜호휘희"
KANJI = "佐藤田中山本木村林高橋伊渡辺小松井上石川原野内西東北南森池前後清水大島"
HANZI = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
THAI = "สมชายวิไลอนันต์ประเสริฐกมลมาลีสุดาธนา"
ROADS = "Street St Road Rd Avenue Ave Boulevard Blvd Lane Ln Drive Dr Court Ct Close Terrace Way Place Circle Parkway Trail".split()
STEMS = "Marl Umber Larks Copper Brindle Sedge Tansy Wicker Hollow Gable Elder Ash Oak Maple Cedar River Stone Mill Church Park Hill Lake Fern Birch".split()
TAILS = "mere hurst wood crest stone field moor vale ridge brook side gate ton view".split()
HOSTS = "inbox mail post letters quay webbox fahrpost my-mail kr.mail office.mail home-net".split()
TOPS = "example test invalid com net org co.kr example.com example.net example.org es".split()


def capital(r: random.Random, parts: list[str]) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 2))).capitalize() + r.choice(parts)


def latin(r: random.Random, whole: bool = True) -> str:
    given, family = capital(r, ENDS[:15]), capital(r, ENDS[10:])
    if not whole:
        return given if r.random() < 0.6 else family
    return r.choice([f"{given} {family}", f"{given} {family}", f"{given} {r.choice('ABCDEHJKLMRST')}. {family}"])


def hangul(r: random.Random) -> str:
    family = r.choice(HANGUL_NAMES) if r.random() < 0.7 else r.choice(["남궁", "독고", "제갈", "황보", "선우", "사공"])
    return family + "".join(r.choice(HANGUL_GIVEN) for _ in range(r.choice([1, 2, 2, 2])))


def pick(r: random.Random, letters: str, a: int, b: int) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(a, b)))


def digits(r: random.Random, n: int) -> str:
    return pick(r, "0123456789", n, n)


def email(r: random.Random) -> str:
    given, family = latin(r, False).lower(), latin(r, False).lower()
    user = r.choice([f"{given}.{family}", f"{given}_{family}", f"{family}{digits(r, 2)}", f"{given[0]}{family}", f"{family}+car", f"{given}-19{digits(r, 2)}", given])
    host = f"{r.choice(HOSTS)}.{r.choice(TOPS)}"
    x = r.random()
    if x < 0.72:
        return f"{user}@{host}"
    if x < 0.80:
        return f"{user} [at] {host.replace('.', '[dot]')}"
    if x < 0.88:
        return f"{user.replace('.', ' dot ')} at {host.replace('.', ' dot ')}"
    if x < 0.92:
        return f"{user} (at) {host.replace('.', ' (dot) ')}"
    return f"{user} @ {host}" if x < 0.96 else f"{user}＠{host}"


def phone(r: random.Random) -> str:
    a, b, c = str(r.randint(2, 9)) + digits(r, 2), r.choice([digits(r, 3), "555"]), digits(r, 4)
    x = r.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"{a}–{b}–{c}", f"{a} / {b} / {c}", f"area code {a}, then {b} {c}"])
    return x + (f" ext. {digits(r, 2)}" if r.random() < 0.15 else "")


def korean_phone(r: random.Random) -> str:
    b, c = digits(r, 4), digits(r, 4)
    return r.choice([f"010-{b}-{c}", f"010 {b} {c}", f"010{b}{c}", f"+82 10-{b}-{c}", f"010.{b}.{c}", f"02-{digits(r, 3)}-{c}", f"031-{digits(r, 3)}-{c}", phone(r)])


def vin(r: random.Random) -> str:
    letters = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
    v = pick(r, letters, 8, 8) + r.choice("K" + letters) + pick(r, letters, 2, 2) + digits(r, 6)
    return r.choice([v, v, v, v, v.lower(), f"{v[:3]} {v[3:9]} {v[9:]}", f"{v[:3]}-{v[3:9]}-{v[9:]}"])


def tail(r: random.Random) -> str:
    return r.choice("ABCDEFGHK") + digits(r, 7) if r.random() < 0.7 else digits(r, r.choice([6, 8]))


def license(r: random.Random) -> str:
    return r.choice([f"{r.choice('ABCDEFGHKLMNQSTW')}{digits(r, 3)}-{digits(r, 4)}-{digits(r, 4)}", f"{r.choice('ABDMST')}{digits(r, 7)}", f"{digits(r, 2)}-{digits(r, 2)}-{digits(r, 6)}-{digits(r, 2)}"])


def social(r: random.Random) -> str:
    a, b, c = digits(r, 3), digits(r, 2), digits(r, 4)
    return r.choice([f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}-{b}-{c}", f"***-**-{c}"])


def resident(r: random.Random) -> str:
    d = digits(r, 6)
    return r.choice([f"{d}-{r.choice('1234')}{digits(r, 6)}", f"{d}-{r.choice('1234')}******", f"{d} - {r.choice('1234')}{digits(r, 6)}"])


def road(r: random.Random) -> str:
    return r.choice(STEMS) + r.choice(TAILS)


def address(r: random.Random) -> str:
    n, x = r.randint(2, 19999), r.random()
    if x < 0.14:
        return r.choice(["PO Box", "P.O. Box", "po box", "P. O. Box"]) + f" {n}"
    if x < 0.22:
        return f"Rural Route {r.randint(1, 9)}, Box {n}"
    if x < 0.32:
        return f"{n} {r.choice(['County Rd', 'County Road', 'State Hwy', 'Farm Road'])} {r.randint(1, 99)}"
    side = r.choice(["", "", "", "N. ", "S. ", "West "])
    house = r.choice([f"{n}", f"{n}", f"{n}-B", f"No. {n % 99}"])
    unit = r.choice(["", "", f", Apt. {r.randint(1, 40)}", f", Unit {r.randint(1, 40)}", f" #{r.randint(1, 40)}"])
    return f"{house} {side}{road(r)} {r.choice(ROADS)}{unit}"


def spanish_address(r: random.Random) -> str:
    name = capital(r, ["ana", "erta", "inda", "orrío", "alba", "edo", "ena"])
    return r.choice([f"Calle {name} {r.randint(1, 300)}", f"C/ {name} {r.randint(1, 300)}", f"Avenida de {name}, n.º {r.randint(1, 300)}", f"Plaza {name} {r.randint(1, 40)}"])


def korean_address(r: random.Random) -> str:
    town, street = pick(r, "가나다라마바사아자하강산들솔물빛바람", 1, 2), pick(r, "달물빛결솔꽃나무하늘바람들은새", 2, 3)
    return r.choice([f"{town}시 {street}로 {r.randint(1, 300)}", f"{town}시 {street}길 {r.randint(1, 90)}-{r.randint(1, 30)}", f"{town}구 {street}로{r.randint(2, 40)}번길 {r.randint(1, 90)}", address(r)])


VALUES = {
    "person_name": latin, "given": lambda r: latin(r, False), "family": lambda r: latin(r, False), "turned": lambda r: f"{latin(r, False)}, {latin(r, False)}", "hangul": lambda r: hangul(r) if r.random() < 0.75 else latin(r),
    "kanji": lambda r: pick(r, KANJI, 2, 4), "hanzi": lambda r: r.choice(HANZI) + pick(r, KANJI + HANZI, 1, 2), "thai": lambda r: pick(r, THAI, 4, 8),
    "email": email, "phone": phone, "kphone": korean_phone, "vin": vin, "tail": tail, "license": license, "social": social, "resident": resident, "address": address, "saddress": spanish_address, "kaddress": korean_address,
}
KIND = {"given": "person_name", "family": "person_name", "turned": "person_name", "hangul": "person_name", "kanji": "person_name", "hanzi": "person_name", "thai": "person_name", "kphone": "phone", "vin": "id_number", "tail": "id_number", "license": "id_number", "social": "id_number", "resident": "id_number", "saddress": "address", "kaddress": "address"}
SENTENCES = {
    "en": """My name is <person_name>.|My name's <person_name> and I own this car.|This is <person_name> writing.|Owner name: <person_name>.|Name: <person_name>|Signed, <person_name>.|Sincerely, <person_name>|Regards, <person_name>|Sent by <person_name> (<email>).
Contact <person_name> at <phone> or <email>.|Please contact <person_name> on <phone>.|I, <person_name>, license <license>, state this under oath.|I, <person_name>, am the registered owner.|My wife <given> was in the back seat.|My husband <given> was driving.|My son <given> was hurt.|My brother <given> was in the back seat.|My sister, <given>, saw it too.|My neighbor <given> helped.|My daughter <given> was in the passenger seat.
I spoke with Ms. <family> twice.|I spoke with Mr. <family> about it.|I spoke with Dr. <family> twice.|I spoke with Mrs. <family>.|The service manager, <person_name>, refused to open a case.|The advisor, <person_name>, said it is normal.|A technician named <person_name> looked at it.|Ask for <turned> in the parts office.|Ask for <person_name> at the desk.|<person_name> was behind the wheel.|<person_name> was driving at the time.|<person_name>, <address>, is the registered owner.
You can reach me at <email>.|You can reach me at <phone>.|Write to <email> instead.|Reply to <<email>> please.|The photos came from <email> last week.|My e-mail, <email>, has not changed.|E-mail: <email>|Call me at <phone> in the evening.|Text <phone> for the video.|They left <phone> as a callback.|The direct line is <phone>, ask for the service desk.|Ph <phone>.|Phone: <phone>|My cell is <phone>.|Call <phone>.
I live at <address>, Mirefield.|I live at <address>.|Mail the answer to <address>.|Mail the answer to <address>, Gull Harbor.|<address> is the address on the title.|<address>, Fernhaven is the address on the title.|The car was towed to <address> and still sits there.|The car was towed to <address>, Eldergate and still sits there.|The car is parked at <address> now.|My address is <address>.
VIN: <vin>.|VIN <vin>|The VIN is <vin>.|The vehicle identification number is <vin>.|The title shows <vin> for this car.|Last eight of the VIN are <tail>.|VIN ends in <tail>.|My driver license <license> was copied by the dealer.|My driver's license number is <license>.|DL# <license>|They wanted my social security number, <social>, before lending a car.|My SSN is <social>.|SSN <social> was on the form.""",
    "es": """Me llamo <person_name>.|Mi nombre es <person_name>.|El encargado, <person_name>, dejó el <phone>.|Hablé con el Sr. <family> dos veces.|La Sra. <family> no contestó.|Mi esposa <given> iba en el asiento trasero.|Mi hermano <given> conducía.|Mi correo es <email>.|Escriban a <email>.|Llámenme al <phone> por la tarde.|Mi teléfono es <phone>.|Vivo en <saddress>, 3.º B.|Vivo en <saddress>.|La dirección es <saddress>, 1.º A.|El VIN es <vin>.|El número de bastidor es <vin>.|Mi licencia de conducir es <license>.|Firmado, <person_name>.""",
    "ko": """차주 <hangul>, <kphone>로 연락 요망.|차주 <hangul>, <kphone>.|정비사 <hangul> 씨가 점검함.|운전자 이름은 <hangul>라고 함.|제 이름은 <hangul>입니다.|담당자 <hangul> 님과 통화했습니다.|<kphone>로 전화 요청함.|연락처는 <kphone>입니다.|<email>로 회신 요청함.|문의<email>에서 접수됨.|이메일은 <email>입니다.|차대번호 <vin> 기재됨.|차대번호는 <vin>입니다.|차대번호 끝자리 <tail> 확인됨.|주민번호 <resident> 노출됨.|주민등록번호 <resident>가 적혀 있음.|면허번호 <license> 기재됨.|견인 장소는 <kaddress>.|<kaddress> 자택 주차 중 발화.|주소는 <kaddress>입니다.|<kaddress>에서 견인됨.""",
    "ja": "担当の<kanji>さんが点検した。|私の名前は<kanji>です。|連絡先は<phone>です。|メールは<email>です。|車台番号は<vin>である。|<email>に返信してください。|<phone>に電話してください。",
    "zh": "我叫<hanzi>。|我的名字是<hanzi>。|请致电<phone>。|我的邮箱是<email>。|车架号是<vin>。|请回复到<email>。|维修工<hanzi>检查了车。",
    "th": "ชื่อ<thai> |โทร <phone> |อีเมล <email> |เลขตัวถัง <vin> |ติดต่อ<phone> |ส่งมาที่ <email> ",
}
#: What private data is mistaken for; nothing here is marked.
OTHERS = {
    "en": """The part number is {2}-{4}-XC.|Reference {8}.|Ref {8}.|Ref. {6}.|Reference {7}|Reference number {6}.|Case reference {5}.|Confirmation {8}.|Serial {7}.|Claim {3}-{6}.|It jammed across my chest, and it was not the first time.|Outside Port St. Marrow, flames were seen.|On Jan. {1}, 2019 it failed.|At {5} mi every gauge went dark.|Both headlights went out.|Repair order #{8} lists the work.|Opened case #{8}.|Case RO {6}.|Bulletin {4}-44-0{3} does not cover my year.|Invoice {10} was paid.|Order {3}-{7} shipped.|The lot is on Brindle Ave.|Traffic backed up from exit 12 to Mill Road.|On Route {2} near exit {2}.|It was towed to Gull Harbor.|Blue Heron Service Co. could not help.|I bought the 20{2} Velmora Tarn.|The mileage was {2},{3} miles.|It cost ${1},{3}.{2}.|On 0{1}/1{1}/201{1} it failed.|My name was left off the work order.|The address on file was out of date.|The VIN plate was too rusty to read.|The phone went dead.|The hotline menu, option {1}, rang.|Call the dealer.|Ticket {3}-{3}-{4} was closed.|Campaign {2}V{3} applies.|Software 4.{1}.{1} was installed.|The tow truck from Ten Mile Tow came.|I drove {2} miles on County Road.|Ask for the service desk.|Contact the dealer.|The dealer, Blue Heron Motors, said no.""",
    "es": "La pieza n.º {2}-{4}-DA está agotada.|La orden {8} está abierta.|Esperé {2} minutos.|El taller cobró ${1},{3}.{2}.|Pasó otra vez el 0{1}/1{1}/2018.|Según la pág. {1} del manual.|La calle estaba mojada.",
    "ko": "부품 {2}-{4}-BB 재고가 없습니다.|시속 {2} km에서 멈췄다.|수리비 ${1},{3}.{2}가 청구됐다.|접수번호 {8} 확인됨.|고객 센터에 알렸습니다.|2019년 {1}월 발생.|견인차를 불렀습니다.|정비사가 점검함.|차주가 확인함.",
}
_SLOT = re.compile(r"<([a-z_]+)>")


def sentence(r: random.Random, lang: str, held_out: bool | None) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence with its spans. held_out: only every fifth written sentence, or only the others; None: any."""
    all_ = re.split(r"[|\n]", SENTENCES[lang])
    some = [s for i, s in enumerate(all_) if held_out is None or (i % 5 == 4) == held_out]
    pattern, out, spans, at = r.choice(some), "", [], 0
    for m in _SLOT.finditer(pattern):
        out += pattern[at : m.start()]
        value = VALUES[m[1]](r)
        spans.append((len(out), len(out) + len(value), KIND.get(m[1], m[1])))
        out, at = out + value, m.end()
    return out + pattern[at:], spans


def other(r: random.Random, lang: str) -> str:
    lang = lang if lang in OTHERS else "en"
    return re.sub(r"\{(\d+)\}", lambda m: digits(r, int(m[1])), r.choice(re.split(r"[|\n]", OTHERS[lang])))


def language(text: str) -> str:
    for lang, letters in (("ko", "가-힣"), ("ja", "ぁ-んァ-ン"), ("th", "ก-๛"), ("zh", "一-龥")):
        if re.search(f"[{letters}]", text):
            return lang
    return "es" if re.search(r"[¿¡ñáéíóú]|\b(?:el|la|los|del|una)\b", text) else "en"


def mixed(r: random.Random, background: str, spans: list[tuple[int, int, str]], held_out: bool | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with marked spans into which a written sentence or two are put, between its sentences; whole texts in one case now and then."""
    lang, text, marks = language(background), background, list(spans)
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        s, own = sentence(r, lang, held_out) if r.random() < 0.8 else (other(r, lang), [])
        gaps = [0, len(text)] + [m.end() for m in re.finditer(r"[.!?。]\s+|\n", text)]
        at = r.choice([g for g in gaps if not any(a < g < b for a, b, _ in marks)])
        lead = r.choice([" ", " ", "\n", "  ", ""]) if at == len(text) else ""
        trail = r.choice([" ", " ", " ", "\n", "", "  "])
        marks = [(a, b, k) if b <= at else (a + len(lead + s + trail), b + len(lead + s + trail), k) for a, b, k in marks] + [(at + len(lead) + a, at + len(lead) + b, k) for a, b, k in own]
        text = text[:at] + lead + s + trail + text[at:]
    x = r.random()
    changed = text.upper() if x < 0.15 else text.lower() if x < 0.25 else text
    return (changed if len(changed) == len(text) else text), sorted(marks)
