"""Small tables of literal texts, with what the detectors must find in them, written by hand."""

from __future__ import annotations

#: detector -> (text, values found in order).
CASES = {
    "NUM_FISCAL": [("fiscal 1234567890123 fin", ["1234567890123"]), ("4234567890123", []), ("page 1234567890123", []), ("12345678901234", [])],
    "NIR": [("x 1 - 85 . 01 -- 2A 123  456 78 y", ["1 - 85 . 01 -- 2A 123  456 78"]), ("1 85 13 75 123 456 78", []), ("185017512345678", ["185017512345678"]), ("385017512345678", [])],
    "IBAN": [("iban pl61-1090-1014-0000-0712-1981-2874.", ["pl61-1090-1014-0000-0712-1981-2874"]), ("FR7630006000011234567890189", []), ("pl61-1090-1014-0000-0712-1981-2875.", [])],
    "CB": [("cb 4532 0151 1283 0366 fin", ["4532 0151 1283 0366"]), ("1234567890123456", []), ("4532-0151-1283-0366", ["4532-0151-1283-0366"])],
    "CVV": [("cryptogramme: 123", ["cryptogramme: 123"]), ("CVV 1234 et cv2-987", ["CVV 1234", "cv2-987"]), ("cvv123", []), ("cvc : 12", [])],
    "SIRET": [("siret 732.829.320 00074", ["732.829.320 00074"]), ("732829320", ["732829320"]), ("732829321", [])],
    "MAILTO": [("MAILTO:bob@x.fr", ["MAILTO:bob@x.fr"]), ("mailto: bob@x.fr", []), ("bob@x.fr", [])],
    "EMAIL_OBFUSCATED": [("voir bob @ mail . co.uk fin", ["bob @ mail . co.uk"]), ("-.bob[arobase]mail point fr", ["bob[arobase]mail point fr"]), ("a [at] b [dot] c et d (AT) e (DOT) f", ["a [at] b [dot] c", "d (AT) e (DOT) f"]), ("bob at mail dot fr", [])],
    "EMAIL_AVEC": [("De : Jean Dupont <j@x.fr>", ["De : Jean Dupont <j@x.fr>"]), ("cc:Bob<b@x.fr> To: Al<a@y.fr>", ["cc:Bob<b@x.fr>", "To: Al<a@y.fr>"]), ("De : <j@x.fr>", [])],
    "EMAIL_ESPACE": [("bob@mail . co.uk", ["bob@mail . co.uk"]), ("bob@mail fr", ["bob@mail fr"]), ("a@b. Merci bien", ["a@b. Merci"]), ("bob@mail", [])],
    "EMAIL": [("bob@x.fr", ["bob@x.fr"]), ("un a.b+c@d-e.co.uk. Fin", ["a.b+c@d-e.co.uk."]), ("@x.fr", []), ("bob@localhost", [])],
    "TEL_FUZZY": [("tel 06 123 456 78 fin", ["06 123 456 78"]), ("0033 6_12_34_56_78", ["0033 6_12_34_56_78"]), ("00 12 34 56 78", []), ("061234567", [])],
    "TEL_PREFIXE": [("Tel : 12 34 ", ["Tel : 12 34 "]), ("hotel: 5", ["tel: 5"]), ("tel 12", [])],
    "TEL": [("au +336--12.34 56 78", ["+336--12.34 56 78"]), ("01 23 45 67 89", ["01 23 45 67 89"]), ("06 123 456 78", [])],
    "URL": [("sur https://x.fr/a?b", ["https://x.fr/a?b"]), ("www.a.fr, http://b.fr.", ["www.a.fr,", "http://b.fr."]), ("ftp://x.fr", []), ("HTTP://X.FR", [])],
    "ORGA": [("la Un Deux Trois SARL", ["Un Deux Trois SARL"]), ("Les Amis ASSOCIATION et", ["Les Amis ASSOCIATION"]), ("Dupont SAS", ["Dupont SAS"]), ("dupont SAS", []), ("Dupont Sas", [])],
    "VOIE_NUM": [("12345 rue de la paix, Paris", ["12345 rue de la paix"]), ("3 bis rue Verte 75002", ["3 bis rue Verte "]), ("12 place de la Paix", [])],
    "VOIE_SANS": [("vers route Nationale.", ["route Nationale"]), ("une AVENUE des Lilas\nfin 3", ["AVENUE des Lilas\nfin "]), ("quai de Seine", []), ("rue de", [])],
    "CP": [("code 94110 France", ["94110"]), ("94110 Montreuil", []), ("lot 12345", []), ("dossier 94110", []), ("941100", [])],
    "DATE_NAISS": [("naissance du : 1.2.85", ["naissance du : 1.2.85"]), ("Née le 12/04/1985", ["Née le 12/04/1985"]), ("le 12/04/1985", [])],
    "GPS": [("ici 48.85, 2.35 fin", ["48.85, 2.35"]), ("90.00 -179.5", ["90.00 -179.5"]), ("48, 2", [])],
    "PLAQUE": [("auto AB 123 CD", ["AB 123 CD"]), ("AB123CD et 1234-ABC-75", ["AB123CD", "1234-ABC-75"]), ("ab-123-cd", [])],
    "VILLE_COMPOSEE": [("NEUILLY SUR SEINE", ["NEUILLY SUR SEINE"]), ("VILLE-DE-PARIS", ["VILLE-DE-PARIS"]), ("SAINT-DENIS", []), ("Neuilly sur Seine", [])],
    "IPV4": [("ip 010.0.0.1", ["010.0.0.1"]), ("256.1.1.1", []), ("1.2.3.4.5", ["1.2.3.4"]), ("192.168.1.255", ["192.168.1.255"])],
    "IPV6": [("ip ::ffff:abcd", ["::ffff:abcd"]), ("ip fe80:1:: fin", ["fe80:1::"]), ("2001:db8:0:0:0:0:0:1", ["2001:db8:0:0:0:0:0:1"])],
    "MAC": [("00:1A-2b:3c:4d:5e", ["00:1A-2b:3c:4d:5e"]), ("00:1A:2b:3c:4d", [])],
    "JWT": [("eyJabcdefghij.eyJabcdefghij.abcdefghij", ["eyJabcdefghij.eyJabcdefghij.abcdefghij"]), ("eyJa.b.c", [])],
    "API_KEY": [("api_abcdefghij0123456789", ["api_abcdefghij0123456789"]), ("sk_short", []), ("xsk_abcdefghij0123456789", [])],
}
#: text, place and length of a number, whether its neighbourhood speaks against it.
CONTEXTS = [("voir page 42 du rapport", 10, 2, True), ("total de 300 euros", 9, 3, True), ("décret 12345", 7, 5, True), ("38000 Grenoble", 0, 5, True), ("75002 merci", 0, 5, True), ("code postal 94110 France", 12, 5, False), ("94110 Lyon", 0, 5, False)]
#: validator, value, verdict.
VALIDATORS = [
    ("luhn_check", "4532015112830366", True), ("luhn_check", "1234567890123456", False), ("luhn_check", "12345", False), ("luhn_check", "732829320", False), ("luhn_raw", "732829320", True), ("luhn_raw", "12345678", False),
    ("siret_check", "732 829 320 00074", True), ("siret_check", "732829321", False), ("nir_check", "1 85 01 75 123 456 78", True), ("nir_check", "1 85 13 75 123 456 78", False), ("iban_check", "FR7630006000011234567890189", True), ("iban_check", "XX1234", False),
]
#: What overlap folding leaves of all detectors together, with type and place.
MIXED = [
    ("Ecrire à bob@example.com ou 06 12 34 56 78", [("email_txt", 9, "bob@example.com"), ("tel_txt", 28, "06 12 34 56 78")]),
    ("Appelez le 01 23 45 67 89 à 94110 France", [("tel_txt", 11, "01 23 45 67 89"), ("cp_txt", 28, "94110")]),
    ("IP 192.168.1.1 chez Dupont SARL", [("ipv4_txt", 3, "192.168.1.1"), ("orga_txt", 20, "Dupont SARL")]),
    ("rien à voir", []), ("", []), (None, []),
]
#: Names as found in texts, and the key that their tokens share.
PERSONS = [("Dupont Jean", "dupont jean"), ("jean  DUPONT", "dupont jean"), ("M. Dupont", "dupont m"), ("Mme Durand", "durand"), ("Jean d'Arc", "jean d'arc"), ("Anne Marie Durand", "anne marie durand"), ("[PERSONNE_3] Paul", "paul"), ("123", "")]
