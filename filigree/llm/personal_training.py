"""Labelled texts made by rule, to train the recognizer of personal information on.

Each text is a list of parts; a part is plain text or (kind, mention). Sentences are put together from short openings,
mentions and endings of everyday correspondence in four languages, with words drawn at random in between, so that
formats and general context words carry the decision and no sentence is learned by heart. Names, numbers and places are
invented; numbers are drawn over the whole of each general format. Half of the texts hold look-alikes that are no cases.
"""

from __future__ import annotations

import random
import unicodedata
from collections.abc import Sequence

# Common given names of several countries, known to the recognizer as a hint.
GIVEN = """
adam adele adrian agnes alan albert alex alexander alice alma amelie amy ana andre andrea andreas angela anita anna anne
anton antonio arthur astrid barbara bastien beatrice benjamin bernard bruno camille carl carla carlos carmen catherine
cecile charles charlotte chiara christian claire clara claudia daniel david diana diego dominik edith eduardo elena eleni
elias elisa elizabeth emil emily emma erik esther eva fabian fatima felix fernando filip florian frank frederic gabriel
georg george gisela greta hanna hannah hans heinz helen helene henri henry hugo ines ingrid irene isabel ivan jakob james
jan jana jean jens joan john jonas jose josef juan judith julia julian karin karl katharina kevin klaus lars laura lea lena
leo leon linda lisa lucia lucas luis lukas magda manuel marc marco margot maria mario markus marta martin mary mateo maya
michael miriam monika nadia nicolas niklas nina nora olga oliver olivia oskar pablo pascal patrick paul paula pedro peter
philip pierre rafael renate robert rosa ruben ruth sabine samuel sara sergio simon sofia sofie stefan susan teresa thomas
tomas ulrich ursula vera victor walter yvonne zoe
""".split()  # fmt: skip
# Given names the recognizer does not list, so that it learns names from their letters and surroundings.
UNLISTED = """
abigail achim agatha aidan aisha akira alejandra alina amanda amara ambroise anders anselm arnaud arturo aurelie ayesha
babajide balthasar bartosz beate birgit bjorn bogdan brigitte caleb candela cedric celeste chinedu clement colette cornelia
dagmar darius deepak delphine dieter dimitri dolores edgar edwin ekaterina elodie emiliano enrique erika ernst etienne
evelyn farid fatou feng fiona francesca freya gaston gerhard giovanni gloria gonzalo guillaume gunther gustavo hakan harald
hector hiroshi hubert ignacio ikechukwu imogen irina jacqueline jamal jasmin javier jerome jin joaquin johanna jurgen kamil
karolina kenji kerstin khadija konrad kwabena lakshmi leandro leila lorenzo louise ludwig luise malik manfred marcel matteo
mehmet mei mercedes miguel min mirjam mohammed moritz nadine naoko natalia nikolai noemi oksana olaf olivier omar pascale
pilar priya quentin raimund ramona raquel ravi reinhard ricardo rodrigo rosalie rudolf salome samira sanjay santiago
sebastian selim siegfried silvia soren stella sunita sven tamara tariq thibault tiago ulrike valentin vikram viola waltraud
wanjiru wilhelm wolfgang xavier xin yannick yasmin yolanda yuki yusuf zofia
""".split()  # fmt: skip
# Family names, beside the invented ones.
FAMILIES = """
abbott adeyemi aguilar ahmed andersen bauer becker bianchi blanc bonnet brandt brooks castro chen collins costa das diaz dubois
eriksson evans farah fischer fletcher fontaine fuchs garnier gomez graham gupta haas haddad hansen hartmann hayes hoffmann hussain
ibrahim ivanov jansen jimenez johansson kaya kim kowalski kraus lambert larsen lefevre lehmann li lombardi lopez macdonald mahlangu
martinez mbeki mensah mercier meyer mohamed molina moreno murphy nakamura navarro nguyen nowak nunez okafor olsen ortega park patel
perrin popescu quinn ramos reyes ricci romero rousseau sato schmitt schneider serrano shah silva singh suarez takahashi tanaka torres
tran vargas vasquez virtanen wagner walsh wang weber williams wright wu yamada yilmaz zhou ziegler
""".split()  # fmt: skip
# Everyday words for sentences around cases, by language.
_WORDS = {
    "en": "the a our their every some old new small large garden kitchen train letter coffee morning evening window teacher doctor market bridge summer weather music paper story travel family friend answer question breakfast suitcase sells carries opens finds brings repairs paints washes cooks before after with without under near because while and but quickly slowly again often seldom".split(),
    "de": "der die das ein eine unser jede keine alte neue kleine große Garten Küche Brief Kaffee Morgen Abend Fenster Lehrer Markt Brücke Sommer Wetter Musik Papier Reise Familie Freund Antwort Frage Frühstück Koffer Tasche Rechnung Wohnung verkauft trägt öffnet findet bringt malt kocht vor nach mit ohne unter nahe weil während und aber schnell langsam wieder oft selten".split(),
    "fr": "le la un une notre chaque quelques vieux nouvelle petite grande jardin cuisine train lettre café matin soir fenêtre maître marché pont été temps musique papier histoire voyage famille ami réponse question valise vend porte ouvre trouve apporte peint lave avant après avec sans sous près parce pendant et mais vite lentement encore souvent".split(),
    "es": "el la un una nuestro cada algunos vieja nueva pequeña grande jardín cocina tren carta café mañana tarde ventana maestro mercado puente verano tiempo música papel historia viaje familia amigo respuesta pregunta maleta vende lleva abre encuentra trae pinta lava antes después con sin bajo cerca porque mientras y pero rápido despacio otra vez".split(),
}
# What may stand directly before and after a case, by kind; of three words at most.
_BEFORE = {
    "email": ["write to", "mail", "e-mail:", "email", "from:", "contact:", "reply to", "send it to", "schreiben an", "an", "Mail:", "écrire à", "courriel :", "adresse mail", "escribir a", "correo:", "correo", "<", "mailto:", "(", "cc", "kontakt", "連絡先:", "問い合わせ", ""],
    "phone": ["phone:", "phone", "tel", "tel.", "tel:", "mobile", "mobile:", "cell:", "call", "call me on", "ring", "dial", "text", "sms", "SMS:", "fax", "hotline:", "number:", "my number is", "line", "reach us at", "Telefon", "Telefon:", "Tel.", "Mobil", "Handy:", "Nummer:", "Anruf unter", "Rückruf", "Rückruf unter", "téléphone :", "tél.", "portable", "mobile :", "appeler le", "rappeler au", "joindre au", "numéro :", "teléfono:", "teléfono", "móvil", "móvil:", "llamar al", "llame al", "número", "電話:", "電話", "携帯", "連絡は", "WhatsApp", "phone=", "tel=", ""],
    "idno": ["SSN", "SSN:", "ssn=", "social security number", "social security no.", "identity number", "ID no.", "ID number:", "id card", "national id", "national id:", "national insurance", "NI number", "NINO", "passport", "passport no.", "Ausweis", "Ausweis-Nr.", "Personalausweis", "Personalausweis:", "Ausweisnummer", "Kennnummer", "Steuer-ID", "numéro INSEE", "INSEE", "INSEE :", "sécurité sociale", "sécurité sociale :", "numéro d'identité", "carte d'identité", "DNI", "DNI:", "NIF", "NIF:", "NIE", "NIE:", "documento", "documento de identidad", "identidad", "個人番号"],
    "address": ["address:", "address", "lives at", "ship to", "send it to", "office:", "moved to", "at", "to", "visit us at", "home:", "Anschrift:", "Adresse:", "wohnt in", "Lieferung an", "an", "in der", "Büro:", "adresse :", "habite", "livrer au", "domicile :", "au", "dirección:", "vive en", "enviar a", "domicilio:", "en", "住所:", ""],
    "name": ["Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Dr", "Dr.", "Prof.", "Herr", "Herrn", "Frau", "M.", "Mme", "Mlle", "Sr.", "Sra.", "Srta.", "doña", "don", "dear", "hello", "hi", "hallo", "liebe", "bonjour", "chère", "hola", "estimada", "name:", "name=", "author:", "author=", "by", "from", "with", "to", "for", "and", "ask", "thank", "thanks,", "met", "told", "signed,", "regards,", "best,", "contact:", "owner:", "manager:", "responsible:", "assigned to", "approved by", "cc:", "cc", "attn:", "von", "mit", "für", "an", "Gruß,", "Grüße,", "Name:", "Kontakt:", "Autor:", "zuständig:", "seit", "bis", "par", "avec", "pour", "merci,", "nom :", "contact :", "auteur :", "depuis que", "voir", "por", "con", "para", "saludos,", "gracias,", "nombre:", "contacto:", "autor:", "según", "laut", "selon", "until", "both", "--", "-", "“", '"', "(", "our neighbour", "my colleague", "the engineer", "a friend,", "unser Kollege", "meine Chefin", "notre collègue", "mon voisin", "mi colega", "nuestra vecina", "Kind regards,\n", "Regards,\n", "Mit Grüßen\n", "Bien à vous,\n", "Un saludo,\n", "Yours sincerely,\n", "Many thanks,\n", "Viele Grüße\n", "Cordialement,\n", "Muchas gracias,\n", "guest:", "invité :", "invitada:", "Gast:", *[""] * 16],
}
# What tells the kind of a number behind it.
_TOLD_AFTER = {
    "phone": [" rings.", " rang.", " is busy.", " rings out.", " is my number.", " (mobile)", " (phone)", " klingelt.", " ist besetzt.", " (Handy)", " sonne.", " est occupé.", " suena.", " está ocupado.", " へ電話"],
    "idno": [" as identification.", " as my SSN.", " as passport number.", " (passport)", " is my ID.", " is their identity card.", " as identity number.", " als Ausweisnummer.", " (Personalausweis)", " ist die Kennnummer.", " comme identité.", " est mon numéro INSEE.", " como DNI.", " (identidad)", " es mi NIE."],
}
# What may stand between a word that introduces a number and the number.
_LINKS = ["on", "at", "to", "under", "is", "reads", "with", "via", "unter", "lautet", "an", "ist", "au", "est", "sur", "al", "es", "en"]
_AFTER = {
    "email": ["", "", ".", ".", ",", ">", ")", ";", " please.", " works.", " bitte.", " genügt.", " suffit.", " gracias.", " まで。"],
    "phone": ["", "", "", ".", ".", ",", ";", " please.", " tomorrow.", " now.", " rang.", " rings.", " is busy.", " bitte.", " morgen.", " klingelt.", " besetzt.", " demain.", " svp.", " sonne.", " mañana.", " ahora.", " suena.", "へ。", "です。"],
    "idno": ["", "", "", ".", ".", ",", ";", " expired.", " is missing.", " was found.", " fehlt.", " steht hier.", " liegt vor.", " manque.", " est lisible.", " falta.", " aparece aquí.", " as identification.", " as my SSN.", " (passport)", " is my ID.", " is their identity card.", " als Ausweisnummer.", " (Personalausweis)", " comme identité.", " como DNI.", " (identidad)"],
    "address": ["", "", "", ".", ".", ".", ",", ";", " please.", " today.", " bitte.", " heute.", " demain.", " svp.", " hoy."],
    "name": ["", "", ".", ".", ",", ",", ";", ")", " said so.", " agreed.", " wrote it.", " is away.", " called.", " signed it.", " has left.", " and others.", "'s book.", "’s car.", " confirmed this.", " returns.", " arrives.", " approved.", " hat zugesagt.", " ist krank.", " schrieb es.", " kommt später.", " und andere.", " has {}", " will {}", " told {}", " and {}", " feeds {}", " wants {}", " hat {}", " wird {}", " sagt {}", " und {}", " a {}", " est {}", " dit {}", " y {}", " ha {}", " dice {}", " weiter {}", " a signé.", " est absente.", " a dit oui.", " arrive.", " et moi.", " ha firmado.", " está fuera.", " lo dijo.", " llega.", " escribió.", " firmó.", " y yo."],
}
# Words before numbers that are no cases.
_CODES = "order invoice ticket build version release isbn serial part model port page chapter section row line room flight batch lot price total code reference Bestellung Rechnung Ausgabe Seite Zeile Raum commande facture page ligne salle pedido factura página línea sala".split()
# Letters and endings of invented words.
_ONSETS = "b bl br c ch d dr f fl g gl gr h j k kl kr l m n p pr qu r s sch sk sl st t th tr v w y z".split()
_VOWELS = "a a a e e e i i o o u ai au ea ei ia io ou".split()
_CODAS = ["", "", "", "", "l", "m", "n", "r", "s", "t", "x", "nd", "rt", "sk"]
_ENDINGS = "man mann sen son sson berg burg stein feld bach ski sky ez es o a i ini elli escu ov eva idis ard ault eau el er ling mark lund strom dottir quist wood well worth".split()
_TOWNS = "ton ford ham burg ville mouth bury field dorf hausen heim stadt bach court mont sur pont rosa clara mar vista holm by ley port".split()
# Digits and signs of numbers to their full-width form.
_WIDE = {ord(c): 0xFEE0 + ord(c) for c in "0123456789+-()."}
# Shapes of national telephone numbers, 9 for any digit and 8 for one from 1 to 8.
_PHONES = ["+1 899 899 9999", "899-899-9999", "(899) 899-9999", "899.899.9999", "+1899899 9999", "+18998999999", "+1 (899) 899-9999", "+44 20 8999 9999", "020 8999 9999", "+44 (0)189 899 9999", "07899 999999", "+44 7899 999999", "0189 899 9999", "01899 899999", "+49 89 89999-999", "089/89999999", "089 89999 999", "0049 (0)89 89999 999", "+49898999999", "(089) 89999 999", "+49 189 89999999", "0189 8999999", "+33 8 99 99 99 99", "08 99 99 99 99", "08.99.99.99.99", "08-99-99-99-99", "+33 (0)8 99 99 99 99", "0899999999", "+34 899 99 99 99", "899 999 999", "(+34) 899999999", "899-99-99-99", "899999999", "+81 8 8999 9999", "08-8999-9999", "(08) 8999-9999", "+81-8-8999-9999", "090-8999-9999", "080-8999-9999"]


class Maker:
    """``plain`` are common words of a public vocabulary, which make titles, products and places that are no names."""

    def __init__(self, seed: int, plain: Sequence[str] = ()):
        self.r = random.Random(seed)
        self.plain = list(plain) or [w for w in _WORDS["en"] if len(w) > 3]

    def digits(self, shape: str) -> str:
        """shape with 9 for any digit and 8 for a digit from 1 to 8; other characters stay."""
        return "".join(str(self.r.randrange(10)) if c == "9" else str(self.r.randrange(1, 9)) if c == "8" else c for c in shape)

    def invented(self, least: int = 1, most: int = 3) -> str:
        r = self.r
        return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) for _ in range(r.randint(least, most))) + r.choice(_CODAS)

    def family(self) -> str:
        r, how = self.r, self.r.random()
        out = r.choice(FAMILIES) if how < 0.3 else self.invented(1, 2) + r.choice(_ENDINGS) if how < 0.65 else r.choice(self.plain) + r.choice(["", *_ENDINGS]) if how < 0.75 else self.invented(2, 3)
        out = out.capitalize()
        return r.choice(["O'", "Mc", "De ", "Van "]) + out if r.random() < 0.02 else out

    def name(self) -> str:
        r, how = self.r, self.r.random()
        given = (r.choice(GIVEN) if how < 0.3 else r.choice(UNLISTED) if how < 0.65 else self.invented(1, 3)).capitalize()
        if r.random() < 0.15:
            given += "-" + r.choice(r.choice([GIVEN, UNLISTED])).capitalize()
        elif r.random() < 0.22:
            given += "".join(f" {r.choice('ABCDEFGHIJKLMNOPRSTVW')}." for _ in range(1 + (r.random() < 0.15)))
        elif r.random() < 0.05:
            given += " " + r.choice(r.choice([GIVEN, UNLISTED])).capitalize()
        family = self.family()
        if r.random() < 0.07:
            family += "-" + self.family()
        full = f"{family}, {given}" if r.random() < 0.22 else f"{given} {family}"
        return full.upper() if r.random() < 0.07 else full

    def email(self) -> str:
        r = self.r
        first, last = r.choice(r.choice([GIVEN, UNLISTED])), self.family().lower().replace(" ", "")
        local = r.choice([f"{first}.{last}", f"{first}-{last}", f"{last}_{first}", f"{first[0]}{last}", f"{last}{r.randrange(99)}", f"{first}+{self.invented()}", first, r.choice(self.plain).lower()])
        domain = self.invented(1, 3) + r.choice(["", "", "", "-" + r.choice(self.plain).lower(), "." + self.invented(1, 2)]) + r.choice([".example", ".test", ".org", ".com", ".de", ".net", ".fr", ".es", ".io", ".co.uk", ".invalid", ".info"])
        at, dot = r.choice([("@", ".")] * 6 + [(" @ ", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "."), (" [at] ", "."), (" (at) ", " (dot) ")])
        out = local + at + domain.replace(".", dot)
        return out.upper() if r.random() < 0.08 else out

    def phone(self) -> str:
        r = self.r
        if r.random() < 0.2:
            # Any country: a code, then groups.
            groups, left = [], r.randrange(8, 11)
            while left > 1:
                groups.append(self.digits("9" * min(left, r.randrange(2, 6))))
                left -= len(groups[-1])
            return self.digits(r.choice(["+8", "+89", "+899"])) + (s := r.choice([" ", " ", "-", ""])) + s.join(groups)
        return self.digits(r.choice(_PHONES))

    def idno(self) -> str:
        r = self.r
        letter = lambda some="ABCDEFGHJKLMNPQRSTVWXYZ": r.choice(some)
        # Shapes of identity numbers.
        kind = r.randrange(6)
        if kind == 0:
            return self.digits(r.choice(["999-99-9999", "999-99-9999", "999 99 9999", "999999999"]))
        if kind == 1:
            return letter("ABCEGHJKLMNOPQRSTWXYZ") + letter("ABCEGHJKLMNPQRSTWXYZ") + self.digits(r.choice([" 99 99 99 ", "999999", "999999 "])) + letter("ABCD")
        if kind == 2:
            s = r.choice(["", " ", "-"])
            return s.join([r.choice("12"), self.digits("99"), f"{r.randrange(1, 43):02}", self.digits("99"), self.digits("999"), self.digits("999"), self.digits("99")])
        if kind == 3:
            return self.digits(r.choice(["99999999", "99.999.999"])) + r.choice(["", "-"]) + letter()
        if kind == 4:
            return letter("XYZ") + self.digits(r.choice(["9999999", "-9999999-"])) + letter()
        sign = lambda: r.choice("0123456789" * 3 + "CFGHJKLMNPRTVWXYZ")
        body = letter("CFGHJKLMNPRTVWXYZ") + self.digits("9") + sign() + sign(), sign() + sign() + self.digits("9"), self.digits("99")
        return r.choice(["", " ", " "]).join(body)

    def postcode(self) -> str:
        letters = lambda n: "".join(self.r.choice("ABCDEFGHJKLMNPRSTWXYZ") for _ in range(n))
        return letters(self.r.choice([1, 2, 2, 2])) + self.digits(self.r.choice(["8", "8", "89"])) + self.r.choice(["", "", "", "A"]) + " " + self.digits("9") + letters(2)

    def place(self) -> str:
        r = self.r
        return r.choice([self.invented(1, 2), r.choice(self.plain).lower()]).capitalize() + r.choice(_TOWNS) if r.random() < 0.7 else self.invented(1, 3).capitalize()

    def address(self) -> str:
        r, n = self.r, self.r.randrange(1, 250)
        street, town = self.place(), self.place()
        zip5, kind = self.digits("99999"), r.randrange(8)
        road = r.choice(["Road", "Street", "Lane", "Avenue", "Close", "Drive", "Way", "Court", "Place"])
        if kind == 0:
            return f"{n} {street} {road}{r.choice([', ', ', ', chr(10)])}{town}{r.choice([' ', ', '])}{zip5}"
        if kind == 1:
            return f"{n}{r.choice('AB')} {street} {r.choice(['Rd', 'St', 'Ave', 'Ln', 'Dr', 'Blvd'])}, {town}, {zip5}"
        if kind == 2:
            return f"{r.choice(['Flat', 'Apt', 'Unit', 'Suite'])} {n % 30 + 1}, {n} {street} {road}, {town}{r.choice([' ', ', '])}{self.postcode()}"
        if kind == 3:
            return f"P.O. Box {n}, {town} {zip5}" if r.random() < 0.5 else f"{n} {street} {road}, {town} {self.postcode()}"
        if kind == 4:
            way = r.choice(["rue", "avenue", "allée", "chemin", "boulevard", "place", "quai", "impasse"])
            return f"{n}{r.choice([f' {way} ', f' bis, {way} de ', f', {way} de ', f', {way} '])}{street}, {zip5} {town}"
        if kind == 5:
            return f"{street}{r.choice(['straße', 'str.', 'allee', 'gasse', 'weg', 'platz', 'ring'])} {n}{r.choice(['', '', 'a', 'b'])}, {zip5} {town}"
        if kind == 6:
            return f"{street}-{r.choice(['Straße', 'Allee', 'Platz'])} {n}{r.choice(['', *'abc'])}, {r.choice(['', 'D-'])}{zip5} {town}"
        return f"{r.choice(['Calle', 'C/', 'Avenida', 'Plaza', 'Camino', 'Paseo'])} {street}{r.choice([f' {n}', f', {n}', f', {n}, {n % 6 + 1}º {r.choice(chr(65) + chr(66) + chr(67))}'])}, {zip5} {town}"

    def words(self, language: str, count: int) -> str:
        """Words of a language with invented ones between them, some capitalized, but no two of these in a row."""
        r, out = self.r, []
        for _ in range(count):
            x = r.random()
            word = r.choice(_WORDS[language]) if x < 0.8 else self.invented().capitalize() if x < 0.84 else self.invented()
            if out and word[0].isupper() and out[-1][0].isupper():
                word = r.choice([w for w in _WORDS[language] if w[0].islower()])
            out.append(word)
        return " ".join(out)

    def title(self) -> str:
        """Capitalized words that name a thing, a product or a place."""
        r = self.r
        common = lambda: r.choice(self.plain).capitalize()
        return r.choice([f"{common()} {common()}", f"{common()} {common()}", f"{common()} {self.invented().capitalize()}", f"{common()} {common()} {common()}", f"{self.invented().capitalize()} {common()}", f"{common()} {r.choice(['Street', 'Road', 'Lane', 'Square', 'Bridge', 'Station'])}"])

    def noun(self) -> str:
        """A German noun, known or made up."""
        r = self.r
        known = r.choice([w for w in _WORDS["de"] if w[0].isupper()])
        return known if r.random() < 0.4 else (self.invented(1, 2) + r.choice(["ung", "ung", "heit", "keit", "er", "schaft", "stück", "werk", "zeit", "plan"])).capitalize()

    def prose(self) -> str:
        """A sentence with capitalized or shouted words that are no names."""
        r = self.r
        language = r.choice(list(_WORDS))
        first, last = self.words(language, r.randrange(1, 5)), r.choice([w for w in _WORDS[language] if w[0].islower()]) + " " + self.words(language, r.randrange(2, 6))
        # Capitalized things and invented words behind nouns, articles and at the beginning.
        middle = r.choice([self.title(), f"{self.invented().capitalize()}", f"{r.choice(['der', 'die', 'das', 'den', 'jede', 'eine'])} {self.noun()} {self.invented().capitalize()}", f"the {self.title()}", f"{r.choice(['den', 'einen', 'eine', 'die', 'der', 'das', 'jeden', 'keinen'])} {self.invented()}{r.choice(['en', 'e', 'er', 'es'])} {self.noun()} {self.invented().capitalize()}", f"{r.choice(['le', 'la', 'el'])} {self.title()}", f"{r.choice(['l', 'd', 'L', 'D'])}'{r.choice([self.title(), self.invented().capitalize() + ' ' + self.invented().capitalize(), r.choice(_WORDS['fr']).capitalize()])}", f"{r.choice(['See', 'Set', 'Voir', 'Siehe', 'Ver', 'Note', 'Use'])} {self.invented().capitalize()}", "", ""])
        out = " ".join(x for x in (first, middle, last) if x) if r.random() < 0.8 else f"{middle} {last}".strip()
        out = out[:1].upper() + out[1:] + r.choice([".", ".", ".", "!", ":", f" ({r.randrange(9999)} ms)."])
        if language == "de" and r.random() < 0.3:
            out = f"{r.choice(['Der', 'Die', 'Das', 'Jede', 'Keine', 'Ohne', 'Trotz', 'Vor', 'Nach', 'Laut', 'Seit', 'Bis', 'Gegen', 'Über', 'Unter', 'Am', 'Im', 'Zwischen', 'Ab', 'Je'])} {self.noun()} {r.choice([self.invented().capitalize() + ' ', '', ''])}{last}."
        return out

    def lookalike(self) -> str:
        """Numbers, codes, handles and titles that resemble cases and are none."""
        r, d = self.r, self.digits
        word = r.choice([*_CODES, self.invented(), r.choice(self.plain)])
        label = r.choice([str.lower, str.capitalize, str.capitalize, str.upper])(word) + r.choice([" ", " ", ": ", "=", " no. ", " #"])
        number = r.choice(["89 99 999", "8.99.9-999", "978-9-99-99999-9", "899999999999", "99.89.9.9", "89-99-999", "89-999-99", "2099-09-19 09:59", "2099-09-19", "8a9999999bb", "+8999", "8.9.9", "2099-99999999", "99 9999 9999", "8,999,999", "8999999", "8999 8999 8999", "99/999/9999", "89 9999 999", "999-8999", "8999.99", "0x8a9b", "99:59:59"])
        hexed = "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(7, 13)))
        number = hexed if r.random() < 0.15 else number
        person = r.choice(r.choice([GIVEN, UNLISTED])).capitalize()
        return r.choice([
            f"{label}{d(number)}{r.choice(['.', ',', ' ' + self.words('en', 2) + '.'])}", f"{label}{d(number)}{r.choice(['.', ',', ' ' + self.words('de', 2) + '.'])}", f"{label}{d(number)}{r.choice(['.', ',', ' ' + self.words('fr', 2) + '.'])}",
            f"{self.invented()}@{r.choice([self.invented(), 'localhost', 'host'])} {self.words('en', 3)}.", f"@{self.invented()} #{self.invented()}{d('99')}", f"{self.invented()}@{d('8.9.9')}", f"{self.invented()}.{self.invented()}={d('999')}",
            f"{person} {r.choice(self.plain)} {self.words('en', 2)}.", f"{r.choice(self.plain).capitalize()} {person} {d('89')}.", f"{d('89')} {self.title()}.", f"{self.title()} {self.words('en', 2)}.", f"{self.title()}, {self.title()}",
            f"{d('2099-09-19T09:59:59Z')} {r.choice(['INFO', 'WARN', 'ERROR', 'DEBUG'])} [{self.invented()}] {self.prose()}", f"{d('999')} {r.choice(self.plain)}, {d('8999999')} {r.choice(self.plain)}",
        ])

    def case(self) -> list:
        r, kind = self.r, self.r.choice([*_BEFORE, "name", "name"])
        before, after = r.choice(_BEFORE[kind]), r.choice(_AFTER[kind])
        if before[:1].islower() and r.random() < 0.4:
            before = before.capitalize()
        if before and r.random() < 0.35:
            language = r.choice(list(_WORDS))
            before = f"{self.words(language, r.randrange(1, 5))} {before}"
            before = before[:1].upper() + before[1:]
        if before and kind in ("phone", "idno") and before[-1] not in "=:" and r.random() < 0.25:
            before += " " + self.words(r.choice(list(_WORDS)), r.randrange(4)) + " " + r.choice(_LINKS)
            before = " ".join(before.split())
        if kind in _TOLD_AFTER and r.random() < 0.15:
            # Only what follows tells the kind.
            before, after = r.choice(["", "", self.words(r.choice(list(_WORDS)), r.randrange(1, 4))]), r.choice(_TOLD_AFTER[kind])
        elif not before and kind != "name" and r.random() < 0.7:
            before = self.words(r.choice(list(_WORDS)), r.randrange(1, 4)).capitalize()
        after = after.replace("{}", self.words(r.choice(list(_WORDS)), r.randrange(1, 5)) + ".")
        tight = before[-1:] in ("", "<", "(", "=", '"', "“", "\n") or before.endswith("mailto:")
        return [before + ("" if tight else r.choice([" ", " ", " ", " ", " \n"[kind == "address"]])), (kind, getattr(self, kind)()), after if after else r.choice(["", " " + self.words(r.choice(list(_WORDS)), 2) + ".", " " + self.words(r.choice(list(_WORDS)), 3).capitalize() + "."])]

    def text(self) -> list:
        """The parts of a text of a few sentences, possibly upper-cased, widely spaced or decomposed as a whole."""
        r, parts = self.r, []
        if r.random() < 0.08:
            prose = " ".join(self.prose() for _ in range(r.randrange(3, 7)))
            return [prose.upper() if r.random() < 0.6 else prose.replace(r.choice("aeinr"), "\ufffd") if r.random() < 0.25 else prose]
        for _ in range(r.randrange(2, 7)):
            parts += self.case() if r.random() < 0.52 else [r.choice([self.lookalike, self.prose, self.prose])()]
            parts.append(r.choice([" ", " ", "\n", "\n\n", "\r\n"]))
        how = r.random()
        change = (lambda s: s.upper()) if how < 0.1 else (lambda s: s.replace(" ", "  ")) if how < 0.17 else (lambda s: unicodedata.normalize("NFD", s)) if how < 0.2 else (lambda s: s.replace(" ", " ")) if how < 0.23 else (lambda s: s)
        if 0.23 <= how < 0.26:
            return [(p[0], p[1].translate(_WIDE)) if isinstance(p, tuple) and p[0] == "phone" else p for p in parts]
        return [change(p) if isinstance(p, str) else (p[0], change(p[1])) for p in parts]


def labelled(count: int, seed: int, plain: Sequence[str] = ()) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """``count`` texts with the spans (start, end, kind) of their cases."""
    maker, out = Maker(seed, plain), []
    for _ in range(count):
        text, spans = "", set()
        for part in maker.text():
            if isinstance(part, tuple):
                spans.add((len(text), len(text) + len(part[1]), part[0]))
                part = part[1]
            text += part
        out.append((text, spans))
    return out
