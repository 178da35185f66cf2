"""Made-up sentences with personal information of open vocabularies, to train and to measure the model of problem 10.

``Maker`` fills sentence frames with values. Training and held-out makers share nothing but the shapes of values: held-out
names, syllables, domains, streets and frames are never trained on. Used only by ``pii_train`` and the tests.
"""

from __future__ import annotations

import re

# Common given names, family names, street names and words of frames; the held-out ones are never trained on.
GIVEN = "James Robert Michael David Richard Joseph Charles Daniel Matthew Anthony Mark Steven Andrew Kenneth George Edward Brian Kevin Laura Jennifer Linda Elizabeth Susan Jessica Karen Nancy Lisa Betty Sandra Ashley Emily Donna Carol Ruth Helen Anna Klara Jürgen Hans Stefan Ulrike Sabine Heike Wolfgang Dieter Matthias Jonas Élodie Chloé Pierre Jean Luc Camille Julien Mathieu Sophie Amélie Carlos Ana Luis Elena Paolo Giulia Ivan Olga Piotr Marta Wei Mei Kenji Yuki Priya Arjun Fatima Omar Layla Yusuf Amina Ingrid Lars Björn Siobhan Dermot".split()
FAMILY = "Brown Davis Wilson Anderson Taylor Moore Jackson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins Stewart Morris Murphy Cook Rogers Reed Cooper Bailey Kelly Howard Ward Cox Richardson Wood Watson Brooks Bennett Gray Hughes Müller Schmidt Schneider Fischer Weber Becker Hoffmann Schäfer Koch Bauer Richter Klein Wolf Neumann Schwarz Zimmermann Martin Bernard Dubois Lefebvre Moreau Laurent Girard Fournier Rossi Ferrari Rodriguez Lopez Martinez Sanchez Ramirez Kowalski Novak Petrov Ivanova Hansen Nilsson Tanaka Suzuki Chen Wang Singh Patel Haddad Khalil O'Brien McCarthy".split()
HELD_GIVEN = "John William Thomas Peter Sarah Maria Mary Patricia Paul Christine Ursula Gerhard Nathalie François Diego Lucia Ahmed Zainab Erik Noor".split()
HELD_FAMILY = "Smith Johnson Williams Thompson Miller Gonzalez Garcia Jones Peterson Foster Vogel Krüger Mercier Blanchard Romano Popescu Larsson Nakamura Rahman Sharma".split()
STREET = "High Church Station Mill Park Victoria Queen Chapel Bridge Oak Maple Cedar Washington Lincoln Franklin Lake Spring North Market Garden Castle Harbour College Forest Meadow Orchard Sunset Jackson Prospect Pleasant".split()
HELD_STREET = "Elm Baker Pine Walnut Highland Grove River Abbey".split()
STREET_TYPE = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Close Row Court Boulevard Blvd Place Square Terrace Way".split()
GERMAN_STREET = "Haupt Schul Garten Bahnhof Berg Dorf Linden Kirch Wald Ring Birken Post Goethe Mozart Schiller".split()
HELD_GERMAN_STREET = "Rosen Brunnen Mühlen Markt".split()
GERMAN_TYPE = "straße str. strasse weg gasse allee platz".split()
FRENCH_STREET = "de la Gare|des Lilas|Victor Hugo|de l'Église|du Moulin|Pasteur|de Verdun|des Écoles|Jean Jaurès|de la Paix|du Château".split("|")
HELD_FRENCH_STREET = "de la République|des Tilleuls|du Marché|Voltaire".split("|")
ARABIC_GIVEN = "محمد أحمد علي حسن حسين خالد عمر يوسف إبراهيم مصطفى سعيد فاطمة مريم عائشة ليلى هدى سلمى رانيا نادية طارق سامي كريم".split()
ARABIC_FAMILY = "الخطيب المصري الحداد النجار السيد عبدالله منصور الشامي البغدادي حمدان سليمان الزين قاسم الهاشمي العمري درويش صالح".split()
HELD_ARABIC_GIVEN = "زياد نور هالة ماجد وليد سميرة باسم رشا".split()
HELD_ARABIC_FAMILY = "الأحمد الرفاعي شاهين عيسى الحلبي نصار بركات".split()
ARABIC_STREET = "النيل السلام الجامعة المدرسة الحرية الملك الزهور السوق البحر النصر".split()
HELD_ARABIC_STREET = "الوحدة الثورة المسجد الورود".split()
TLD = "com org net edu de fr co.uk ac.uk info eu gov it es ch at ca com.au us".split()
HELD_TLD = "io nl se biz be".split()
MAIL_WORD = "mail post inbox office web online data info team book paper archive library univ city blue north star home tech cloud press media house group lab".split()
HELD_MAIL_WORD = "gmail company fastmail outlook yahoo museum campus".split()

# A bar or line end parts frames, ~ is a line end inside one; {N} name, {E} e-mail, {P} phone, {I} identity number, {A} address, {F} some words
FRAMES = """Please contact {N} at {E} or {P}.|My name is {N} and I live at {A}.|{N} can be reached on {P}.|Call {P} before noon.|Send the copies to {E}, please.|{F} Tel. {P}|Email: {E}|E-mail {E}; phone {P}
You may write to {N} ({E}).|Yours sincerely, {N}|Kind regards,~{N}~{A}~{P}|Her passport number is {I}.|SSN: {I}|The reader's ID {I} was checked.|ID no. {I} {F}|{N} lives at {A} and works here.|{F} signed by {N}.|Dr {N} and Ms {N} compared the copies.
Delivered to {A}.|{N} <{E}>|Contact: {N}, {A}, {P}.|{F} {N} of the reading room noted this.|We spoke with {N} yesterday about it.|{N}, who edits the list, agreed.|National insurance {I}|Ring {N} on {P} today.|Mr {N} moved to {A}.
Bitte an {E} schreiben.|Herr {N} wohnt in der {A}.|Frau {N} hat den Text geprüft.|Telefon {P}|Rufen Sie {N} unter {P} an.|Die Anschrift lautet {A}.|Ausweisnummer {I}|Mit freundlichen Grüßen {N}|Steuernummer: {I}.|{N} ist unter {E} erreichbar.
Veuillez écrire à {E}.|Madame {N} habite {A}.|Monsieur {N} a relu la copie.|Tél. {P}|Appelez {N} au {P}.|Numéro d'identité {I}.|L'adresse est {A}.|Cordialement, {N}
راسل {E} من فضلك.|اسمي {N} وأسكن في {A}.|اتصل على {P}.|رقم الهوية {I}|كتب {N} إلى الجريدة.|السيد {N} قارن النسختين.|الهاتف: {P}|العنوان {A}.|هوية {I}"""
HELD_FRAMES = """Reach me on {P} this week.|{F} Her name is {N}.|Please reply to {E} soon.|{N} asked for a copy.|Our office is at {A}.|His social security number is {I}.|Questions? ({E}).|Thanks to {N} for the loan.|I met {N} and {N} there.|Mobile {P}.
Schreiben Sie mir: {E}|Meine Nummer ist {P}.|Ich heiße {N}.|Wir wohnen {A}.|Mon numéro est le {P}.|Je m'appelle {N}.|Nous habitons {A}.|Carte d'identité {I}.|أنا {N}.|بريدي {E}.|نقيم في {A}.|هاتفي {P}"""
_NONE = """See page 214 and folio 12r of MS 3821.|ISBN 978-3-16-148410-0 was cited.|It was printed on 12.04.1987 in Leiden.|Ibn Rushd wrote the commentary in 1178.|Shelf mark Or. 4456, acc. no. 2019-0447.|Thomas Aquinas quotes the Metaphysics.|The Kitab al-Aghani, vol. 3, p. 455.|Chapters 10-12 agree with lines 104, 221 and 3340.
The bridge at Castle Street is old.|Siehe Seite 33 und Blatt 7v.|Goethe schrieb 1808 darüber.|Voir page 88, tome 2.|Avicenne cite Aristote.|قال ابن خلدون في المقدمة ص ٢١٤.|Signatur Ms. or. quart. 1200|About 1 400 copies, 25 % of 12,500, were sold in 2021-2022.|On Monday the old readers met again in the Reading Room.|Homer, Plato and Cicero are cited."""
WORDS = "the old copy of this page was read again with some care and a second hand added marks in red ink while margins stay clean; it seems that both witnesses agree on most lines but not on their order die alte Handschrift wurde noch einmal gelesen und la page est lue avec soin".split()
_SYL = [a + b for a in ("b", "br", "c", "ch", "d", "f", "fr", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "pr", "r", "s", "sch", "st", "t", "th", "v", "w", "z") for b in ("a", "e", "i", "o", "u", "ai", "ie")]
_CODA = ("", "n", "r", "s", "l", "t", "m", "ck", "nd", "rt", "ng")
_AR = [a + b for a in "بتجحخدرزسشصضطعغفقكلمنهوي" for b in ("", "ا", "ي", "و")]


class Maker:
    """Sentences with spans. ``held``: only held-out words, frames and syllables; else only those for training."""

    def __init__(self, rng, held: bool = False):
        self.rng, self.held = rng, held
        pick = lambda a, b: b if held else a
        self.given, self.family = pick(GIVEN, HELD_GIVEN), pick(FAMILY, HELD_FAMILY)
        self.street, self.german, self.french = pick(STREET, HELD_STREET), pick(GERMAN_STREET, HELD_GERMAN_STREET), pick(FRENCH_STREET, HELD_FRENCH_STREET)
        self.ar_given, self.ar_family, self.ar_street = pick(ARABIC_GIVEN, HELD_ARABIC_GIVEN), pick(ARABIC_FAMILY, HELD_ARABIC_FAMILY), pick(ARABIC_STREET, HELD_ARABIC_STREET)
        self.tld, self.mail = pick(TLD, HELD_TLD), pick(MAIL_WORD, HELD_MAIL_WORD)
        self.frames = [f.replace("~", "\n") for f in re.split(r"\||\n", pick(FRAMES, HELD_FRAMES))]
        self.none = re.split(r"\||\n", _NONE)
        # every third syllable is held out
        self.syl = [s for k, s in enumerate(_SYL) if (k % 3 == 0) == held]
        self.ar = [s for k, s in enumerate(_AR) if (k % 3 == 0) == held]

    def one(self, x):
        return str(x[int(self.rng.integers(0, len(x)))])

    def digits(self, n: int) -> str:
        return "".join(str(int(d)) for d in self.rng.integers(0, 10, n))

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self, least: int = 1) -> str:
        n = int(self.rng.integers(least, 4))
        return "".join(self.one(self.syl) for _ in range(n)) + self.one(_CODA)

    def arabic_word(self) -> str:
        return "".join(self.one(self.ar) for _ in range(int(self.rng.integers(2, 5))))

    def first(self) -> str:
        return self.one(self.given) if self.chance(0.5) else self.word(2).capitalize()

    def last(self) -> str:
        w = self.one(self.family) if self.chance(0.5) else self.word(2).capitalize() + (self.one(["", "son", "er", "man", "ski", "berg", "ova"]) if self.chance(0.4) else "")
        return w + "-" + (self.one(self.family) if self.chance(0.5) else self.word(2).capitalize()) if self.chance(0.06) else w

    def name(self) -> str:
        if self.arabic:
            first = self.one(self.ar_given) if self.chance(0.5) else self.arabic_word()
            last = self.one(self.ar_family) if self.chance(0.5) else ("ال" if self.chance(0.3) else "") + self.arabic_word()
            return f"{last}، {first}" if self.chance(0.12) else f"{first} {last}"
        f, l = self.first(), self.last()
        s = self.one([f"{f} {l}"] * 6 + [f"{f} {self.one('ABCDEFGHIJKLMNOPRSTVW')}. {l}", f"{f[0]}. {l}", f"{l}, {f}", f"{l}, {f[0]}."])
        return s.upper() if self.chance(0.06) else s

    def email(self) -> str:
        f, l = re.sub("[^a-z]", "x", self.first().lower()), re.sub("[^a-z]", "x", self.last().lower())
        local = self.one([f"{f}.{l}"] * 3 + [f"{f[0]}.{l}", f"{f[0]}{l}", f"{f}_{l}", f"{f}{self.digits(2)}", f"{l}", f"{f}-{l}", f"{l}+{self.one(MAIL_WORD)}"])
        part = lambda: self.one(self.mail) if self.chance(0.5) else self.word(1)
        domain = self.one([part(), part(), f"{part()}-{part()}", f"{part()}.{part()}", f"{part()}{part()}"])
        s = f"{local}@{domain}.{self.one(self.tld)}"
        if self.chance(0.08):
            at, dot = self.one([" at ", " [at] ", "(at)", " (at) "]), self.one([" dot ", "[dot]", " [dot] ", "."])
            s = f"{local}{at}{f'{domain}.{self.one(self.tld)}'.replace('.', dot)}"
        return s.upper() if self.chance(0.03) else s

    def phone(self) -> str:
        d = self.digits
        cc = self.one(["1", "44", "49", "33", "39", "20", "961", "41", "34", "90", "966", "43"])
        sep = self.one([" ", " ", " ", "-", ".", ""]) if self.chance(0.9) else "/"
        n = self.one(["3 3 4", "2 4 4", "3 4", "3 7", "2 3 2 2", "4 4", "1 2 2 2 2", "3 2 2 2", "3 6", "4 6"]).split()
        body = sep.join(d(int(x)) for x in n)
        if len(re.sub(r"\D", "", body)) < 7:
            body += (sep or " ") + d(3)
        s = self.one([f"+{cc} {body}", f"+{cc}{sep}{body}", f"+{cc} (0){d(2)} {body}", f"00{cc} {body}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {body}", f"0{d(3)}/{d(6)}", f"(0{d(3)}) {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)} {d(3)} {d(4)}"])
        return s.translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")) if self.arabic and self.chance(0.6) else s

    def idnum(self) -> str:
        d, u = self.digits, lambda n: "".join(self.one("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        s = self.one([f"{d(3)}-{d(2)}-{d(4)}"] * 3 + [f"{u(2)} {d(2)} {d(2)} {d(2)} {u(1)}", f"{u(2)}{d(7)}", f"{u(1)}{d(8)}", f"{u(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(11)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{u(1)}{d(4)} {d(4)}", f"{u(3)}-{d(8)}", f"{d(2)}/{d(3)}/{d(5)}"])
        return s.translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")) if self.arabic and self.chance(0.4) else s

    def address(self) -> str:
        n = str(int(self.rng.integers(1, 400))) + (self.one("abcABC") if self.chance(0.1) else "")
        if self.arabic:
            st = self.one(self.ar_street) if self.chance(0.5) else "ال" + self.arabic_word()
            return self.one([f"شارع {st} {n}", f"{n} شارع {st}"])
        k = self.rng.random()
        if k < 0.55:
            st = self.one(self.street) if self.chance(0.5) else self.word(2).capitalize()
            flat = f"{self.one(['Flat', 'Apt', 'Unit'])} {int(self.rng.integers(1, 40))}, " if self.chance(0.1) else ""
            return f"{flat}{n} {st} {self.one(STREET_TYPE)}"
        if k < 0.8:
            st = self.one(self.german) if self.chance(0.5) else self.word(1).capitalize()
            return f"{st}{self.one(GERMAN_TYPE)} {n}"
        st = self.one(self.french) if self.chance(0.6) else f"{self.one(['de la', 'du', 'des'])} {self.word(2).capitalize()}"
        return f"{n}{self.one([',', ''])} {self.one(['rue', 'avenue', 'place', 'boulevard'])} {st}"

    def filler(self, n: int) -> str:
        if self.arabic:
            return " ".join(self.arabic_word() for _ in range(n))
        return " ".join(self.one(WORDS) if self.chance(0.7) else self.word() for _ in range(n))

    def sentence(self) -> tuple[str, list[tuple[str, int, int]]]:
        frame = self.one(self.frames)
        self.arabic = bool(re.search("[ء-ي]", frame))
        out, spans, pos = [], [], 0
        for k, part in enumerate(re.split(r"\{(\w)\}", frame)):
            if k % 2:
                kind, make = {"N": ("name", self.name), "E": ("email", self.email), "P": ("phone", self.phone), "I": ("idnum", self.idnum), "A": ("address", self.address), "F": (None, lambda: self.filler(4))}[part]
                part = make()
                if kind:
                    spans.append((kind, pos, pos + len(part)))
            out.append(part)
            pos += len(part)
        return "".join(out), spans

    def document(self, sentences: int = 6) -> tuple[str, list[tuple[str, int, int]]]:
        out, spans, pos = [], [], 0
        for _ in range(sentences):
            self.arabic = self.chance(0.25)
            k = self.rng.random()
            if k < 0.25:
                s, sp = self.filler(int(self.rng.integers(4, 16))).capitalize() + ".", []
            elif k < 0.4:
                s, sp = self.one(self.none), []
            else:
                s, sp = self.sentence()
            sep = "\n" if self.chance(0.2) else " "
            spans += [(kind, a + pos, b + pos) for kind, a, b in sp]
            out.append(s + sep)
            pos += len(s) + 1
        return "".join(out), spans
