"""Sentences written by hand, apart from the training's grammar: what the recognizer finds in them, by kind."""

# Fixed values: (kind, mentions, sentences they are put into in turn).
SETS = [
    ("name", [
        "Wei Zhang", "Kwame Nkosi", "Chukwuemeka Obi", "Rajesh Kumar", "Margaret Thornbury", "Søren Kierulf", "Ingeborg Halvorsen", "Tomasz Wieczorek", "Aoife Gallagher", "Dmitri Voronin", "Fatima Al-Sayed", "Pierre-Yves Lacombe",
        "Hedwig Zimmermann", "Concepción Ibarra", "Lluís Ferrer", "Beatrix Oosterhout", "Priyanka Deshmukh", "Jerzy Sobczak", "Mireille Charpentier", "Gideon Blackwood", "Winifred K. Ashdown", "Thaddeus R. Pemberton", "Ndidi Eze", "Björn Lindqvist",
        "Hildegard Vogelsang", "Esperanza Montoya", "Odalys Cienfuegos", "Rainer Schlüter", "Yvette Marchand", "Callum Fairweather", "Saoirse Brennan", "Bartholomew Quill", "Nkechi Umeh", "Gerlinde Pfaff", "Anselme Roux", "Ximena Valdivia", "Torsten Eklund", "Rosalind Harcourt", "Giuseppe Lanza", "Marit Solberg",
    ], [
        "Yesterday Dr. {} examined the patient in room nine.", "Our neighbour {} feeds the cats while we travel.", "Ich habe mit Frau {} telefoniert.", "Le contrat porte la signature de Mme {}.", "La reunión con el Sr. {} se aplaza.", "Kind regards,\n{}", "{} sold the house in 2019.", "The parcel for {} is at reception.", "Bitte leiten Sie das an {} weiter.", "Invitée : {}",
    ]),
    ("phone", [
        "212-736-5000", "+1 (415) 867-5309", "+91 98765 43210", "030 23125000", "+49 30 901820", "01 42 68 53 00", "+33 1 42 68 53 00", "915 21 00 00", "+34 915 210 000", "0161 496 0727", "(0161) 496 0727", "+44 161 496 0727", "617.555.0142", "(206) 684-2489", "+81 3-5253-1111", "+39 06 6982 1234", "+41 44 668 18 00", "089 21233300", "07911 123456", "+1-604-873-7000",
        "06 12 34 56 78", "654 321 987", "+31 20 551 1234", "0221/22125800", "+46 8 508 290 00", "312-744-5000", "+61 2 9265 9333", "(312) 744-5000", "0711 2160", "+55 11 3113 8000",
    ], [
        "You can phone the front desk on {} until six.", "Call {} if the heating fails again.", "Tel: {}", "Meine Handynummer lautet {}.", "Sie erreichen die Praxis unter Telefon {}.", "Pour un rendez-vous, appelez le {} avant midi.", "Llámanos al {} para reservar mesa.", "mobile {}, evenings only", "Fax: {}", "Text {} when you get home.",
    ]),
    ("idno", [
        "219-09-9999", "078-05-1120", "457 55 5462", "AB 12 34 56 C", "JG103759A", "CE 45 67 89 D", "1 85 05 78 006 084 36", "2 69 05 49 588 157 80", "12345678Z", "87654321-X", "X1234567L", "Y-7654321-G", "L01X00T47", "C01X 0006 H1".replace(" ", "")[:9], "T22000129", "536 22 8147", "PP 90 12 34 A", "X-2482300-W", "45.678.912-K", "190037800608436",
    ], [
        "Her social security number is {} according to the form.", "SSN {}", "National insurance number: {}", "Das Dokument nennt die Ausweisnummer {} im Klartext.", "Personalausweis: {}", "Son numéro de sécurité sociale : {}", "Mi DNI es {} y lo perdí.", "NIE {}", "The passport with ID number {} was stolen.", "Identity card no. {}",
    ]),
    ("email", [
        "margaret.thornbury@valleyclinic.org", "tom_w@posteo.de", "info@boulangerie-roux.fr", "kwame+news@accra-press.com", "j.ferrer@uni.example.edu", "HELP@NORTHSHOP.CO.UK", "office@kanzlei-pfaff.de", "a-b.c@sub.domain.net", "sales (at) teahouse (dot) com", "priya [at] mailbox [dot] org", "x.valdivia@correo.example.mx", "bo@lindqvist.se", "reception@hotel-alpin.ch", "n.umeh99@webpost.ng", "callum@fairweather.scot", "r_schlueter@t-post.de", "esperanza@montoya.es", "contact@marchand-vins.fr", "gideon.blackwood@quill.press", "aoife@brennan.ie",
    ], [
        "Questions go to {} before Friday.", "Her new address is {}, she says.", "Rechnungen bitte an {} senden.", "Vous pouvez répondre à {} directement.", "Envíe el formulario a {} hoy.", "E-mail: {}", "{} bounced twice.", "Sign up via {}.", "Newsletter <{}>", "cc {}",
    ]),
    ("address", [
        "14 Orchard Lane, Whitby 30214", "221B Baker Street, London NW1 6XE", "7 Harbour Road, Falmouth TR11 3QY", "Flat 9, 30 Castle Street, Bristol BS1 3XB", "P.O. Box 412, Denver 80201", "1600 Maple Avenue, Springfield, 62704", "Lindenstraße 17, 10969 Berlin", "Hauptstr. 5a, 69117 Heidelberg", "Rosenweg 22, 80331 München", "Goethe-Allee 3, D-37073 Göttingen", "12 rue Lafayette, 75009 Paris", "8 bis, avenue de Verdun, 06000 Nice", "45, boulevard Gambetta, 38000 Grenoble", "3 place Bellecour, 69002 Lyon", "Calle Mayor 10, 28013 Madrid", "Avenida Goya, 55, 50005 Zaragoza", "Plaza Nueva 4, 41001 Sevilla", "C/ Serrano, 12, 3º B, 28001 Madrid", "88 Mill Drive, Leeds LS1 4AP", "Unit 4, 16 Forge Way, Swindon SN2 2DQ",
    ], [
        "The bakery moved to {} last spring.", "Please deliver the piano to {}.", "Postal address: {}", "Er wohnt seit Jahren in der {}.", "Anschrift: {}", "Le cabinet se situe au {}.", "Adresse : {}", "Nuestra tienda está en {}.", "Send the keys to {} by courier.", "Billing address {}",
    ]),
]
# Sentences without any case.
NOTHING = [
    "The River Palace keeps its doors open until nine.", "Invoice 4021-7788 covers March and April.", "Room 12 holds 300 chairs.", "Version 2.14.7 fixed the printing fault.", "The ISBN 978-3-16-148410-0 belongs to a cookbook.", "Flight 2271 left at 18:45 on 2023-07-02.", "Golden Lion and Silver Fox are pubs in the old town.", "Die Neue Zeitung kostet 2,80 Euro.", "Das Große Haus steht am Markt.", "Le Petit Journal paraît le lundi.", "La Gran Vía tiene 1.300 metros.",
    "Serial 88213-4410-2 is printed on the back.", "user@printer waits in the queue.", "Our server listens on 10.20.30.40 port 8080.", "Batch 7731002 passed the second test.", "Green Valley Station opens in May.", "Am Montag liefert der Bäcker 120 Brote.", "Seit Ostern ruht die Arbeit am Dach.", "Order 5512907 contains nine lamps.", "The total of 1,250,000 was rounded.", "Chapter 9, page 214, line 3.", "Checksum 9f86d081884c7d65 matches the file.", "Black Friday starts early this year.", "Every Monday Night the band plays in the cellar.",
]


def sentences():
    """(text, kind, start, end) of every mention, each in two of the kind's sentences."""
    for kind, mentions, frames in SETS:
        for i, mention in enumerate(mentions):
            for k in (i, i + 3):
                before, after = frames[k % len(frames)].split("{}")
                yield before + mention + after, kind, len(before), len(before) + len(mention)
