"""The small labelled table the tagger is trained from: sentence frames with typed slots, filled by rule.

Frames are marked up as {KIND}; everything outside a slot is no personal information. The frames are written for this
table and share no sentence with the notes of the test tables (tests/llm checks that). Fillers are made by rule from syllables
and digit patterns, so no real person, number or place is in the table.
"""

from __future__ import annotations

import random

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Frames that hold personal information. Each is written here; none is taken from a table this repository reads.
FRAMES = """
Please dial {PHONE} between nine and noon.|The switchboard number is {PHONE}, extension {n2}.|{PHONE} ext. {n2} reaches the lab|{PHONE} (fax)|cell: {PHONE}|mob. {PHONE}|Phone {PHONE}; leave a message.|He answers at {PHONE} or by mail, {EMAIL}.|New number {PHONE}, the other one is dead.|{NAME}'s desk phone is {PHONE}|Unter {PHONE} erreichbar.|Handy {PHONE}, abends|Joignable au {PHONE}.|Su teléfono es {PHONE}.|llamar al {PHONE} por la tarde|text them at {PHONE}|{PHONE} rang twice, nobody spoke|Dial-in {PHONE}, pin follows|signal/telegram {PHONE}|number on the card: {PHONE}
husband {NAME} answers under {PHONE}|{NAME} is away until Friday, ask {NAME} ({PHONE})|Zuständig: {NAME}, {PHONE}.|Persona de contacto: {NAME}, {PHONE}.|Contact : {NAME}, {PHONE}.|{NAME} {PHONE}|{NAME}, {PHONE}|{PHONE} {NAME}|{NAME} - {PHONE} - {EMAIL}|regards, {NAME} | {EMAIL} | {PHONE}|best, {NAME} / {PHONE}|{NAME}: {PHONE}, evenings only|Écrire à {EMAIL}, portable {PHONE}.|Mail {EMAIL}, Telefon {PHONE}.|Escribir a {EMAIL} o llamar al {PHONE}.
Reply goes to {EMAIL}.|Our mail to <{EMAIL}> came back.|undeliverable: {EMAIL}|thread started by {EMAIL}, forwarded|put {EMAIL} in copy|use {EMAIL} from now on;|mailto:{EMAIL}|changed to {NAME} <{EMAIL}>|{NAME} <{EMAIL}>|Mrs {NAME} ({EMAIL}) approves.|Prof {NAME} ({EMAIL}) chairs the board.|{EMAIL}|{EMAIL} {PHONE}|{EMAIL}, {PHONE}|{PHONE} / {EMAIL}|the invoice goes to {EMAIL} only|Bitte an {EMAIL} senden.|Merci d'écrire à {EMAIL}.|Enviar la oferta a {EMAIL}.|calendar invite sent, {EMAIL} accepted|login is {EMAIL}
VAT contact gave tax number {ID_NUMBER}.|id number {ID_NUMBER} on file|National identity no. {ID_NUMBER}.|Identity card {ID_NUMBER} copied.|Ausweisnummer {ID_NUMBER} notiert.|Führerschein {ID_NUMBER} liegt vor|Steuernummer {ID_NUMBER} nachgereicht|passport number {ID_NUMBER}, valid|showed passport {ID_NUMBER} and left|driver's license {ID_NUMBER} scanned|license {ID_NUMBER} on record|social security {ID_NUMBER} must be deleted|SSN: {ID_NUMBER}|Numéro fiscal {ID_NUMBER}.|passeport {ID_NUMBER} expiré|permis de conduire {ID_NUMBER}|documento de identidad {ID_NUMBER}|DNI: {ID_NUMBER}|NIF {ID_NUMBER} recibido|número de pasaporte {ID_NUMBER}|tax id {ID_NUMBER} missing a digit|Pers. no. {ID_NUMBER}, kept by HR|signed by {NAME}, identity document {ID_NUMBER}|{NAME}, passport {ID_NUMBER}, {ADDRESS}|badge issued to {NAME}, licence no. {ID_NUMBER}|KYC file: {ID_NUMBER}|AML check passed with card {ID_NUMBER}
Goods go to {ADDRESS}.|Deliveries: {ADDRESS}.|The new office is {ADDRESS}.|They relocated to {ADDRESS} and pay rent till {year}.|courier tried {ADDRESS} twice|pick-up at {ADDRESS}|home address {ADDRESS}|residence: {ADDRESS}|Anschrift: {ADDRESS}.|wohnt in der {ADDRESS}|Rechnung bitte an {ADDRESS}|Siège : {ADDRESS}.|habite {ADDRESS}|Domicilio: {ADDRESS}.|vive en {ADDRESS}|enviar a {ADDRESS}|=> {ADDRESS}|meet at {ADDRESS}; {NAME} opens the door|{NAME} comes from {ADDRESS}|{NAME} kommt aus {ADDRESS}|{NAME} arrive de {ADDRESS}|c/o {NAME}, {ADDRESS}.|{NAME}, {ADDRESS}, {PHONE}|{NAME}, {ADDRESS}|{ADDRESS}|{ADDRESS}, {PHONE}|the crate stands at {ADDRESS}, unopened|inspection of {ADDRESS} on Tuesday
our counterpart is {NAME}.|The former buyer retired; {NAME} took over.|Madame {NAME} confirme.|Frau {NAME} meldet sich.|Herr {NAME} ist im Urlaub.|Señora {NAME} decide.|Mlle {NAME} attend le devis.|Mme {NAME} signe lundi.|M. {NAME} et Mme {NAME} sont absents.|Mme {NAME}, M. {NAME}|We owe this one to {NAME}.|Charla con {NAME}.|Long chat with {NAME} yesterday.|{NAME} introduced us.|secretary: {NAME}|her manager {NAME} reads along|his deputy {NAME} agreed|their lawyer {NAME} objects|talked to {NAME} regarding {product}|asked {NAME} about the {plan}|{NAME} and {NAME} both attended {event}.|Lunch with {NAME} after {event}.|Dr {NAME} has the last word.|keys are with {NAME}|credit to {NAME}|{NAME} asks for a callback|{NAME} ist einverstanden.|Termin mit {NAME} bestätigt.|M. {NAME} refuse.|selon {NAME}, c'est trop cher|{NAME} no contesta|según {NAME}, todo bien|waiting for {NAME}|cc {NAME}|attn {NAME}|ask for {NAME}|owner {NAME}|{NAME}, our sponsor there, moved on|signed: {NAME}|chez {NAME} au bureau|Rendez-vous chez {NAME}, {ADDRESS}.|correo electrónico: {EMAIL}; móvil: {PHONE}|Su correo es {EMAIL}|{NAME} will be back, until then {NAME} ({PHONE})|new buyer {NAME}|the contact is now {NAME}|his wife {NAME} takes calls at {PHONE}|{NAME} checks out|thanks, {NAME}|{words} {NAME} {words}|{words} {NAME} {words}.|{NAME} {words}|{NAME} {words}.|{words} {NAME}|{words} {NAME}.|{words}: {NAME}|{words}; {words} {NAME}.|{words}, {NAME} {words}|{NAME}, {words}|{words} {NAME} and {NAME} {words}|{NAME} {words} {NAME} {words}|{words} {ADDRESS}|{words} {ADDRESS}, {words}|{words} {ADDRESS} {words}|{ADDRESS} {words}|{words} {PHONE} {words}|{words} {PHONE}|{PHONE} {words}|{words} {EMAIL} {words}|{words} {EMAIL}|{words} {NAME} {words} {PHONE}|{words} {NAME} {words} {ADDRESS}|{words} {NAME} ({EMAIL}) {words}|{NAME} quit, {NAME} is the one to ask now|we met {NAME} plus {NAME} at {event}|{NAME} took a sabbatical; call {NAME} on {PHONE}|son {NAME} sits at {PHONE}|mentioned {product} to {NAME}|{NAME} likes {product}|guest pass {NAME}, paper {ID_NUMBER}|deed names {NAME}, number {ID_NUMBER}, from {ADDRESS}|aide is {NAME}|partner is {NAME}|the chief, {NAME}, was informed|both {NAME} and {NAME} signed
"""

# Frames without any.
PLAIN = """
Dead lead, rang three times.|Clicked an advert, came back a week later.|A friend told them about us.|The front desk took the call.|Shipment code KR{n10} on its way.|parcel code {n10}|entered through the reseller site, typed in by a colleague|Nos conocimos en {event}.|Picked up a leaflet at {event}.|Was at {event}, scanned nothing.|Badge scan, {event}.|Talk at {event} was crowded.|Kam über {event} zu uns.|Rencontre au salon {event}.
Support case {n6} unresolved.|case #{n6} closed|ticket {n6}|bug {n5} fixed in v{n1}.{n2}|Strong match.|Offer sent.|Mentioned @dealdesk in the channel.|@billing please look|Runs version {n1}.{n2}.{n1}.{n1}.|on release {n2}.{n1}|Toujours en attente.|Left voice mail, next try Monday.|Money is there from autumn on.|Meldet sich selbst.|Owns {n2} warehouses.|Todavía nada.|Their gateway answers 503, the admins know.|error 404 on the portal|Sent the brochure.|Too early, perhaps next year.|Order {n8} waits for approval.|Order XR-{n7} waits for approval.|purchase order {year}-{n7} open|order no. {n8} delivered {year}-03-{n2}
Bill {n8} unpaid since {n2} days.|Bill XR-{n7} unpaid since {n2} days.|receipt {year}-{n7} attached|invoice no. {n8}|Rechnung {n8} offen|facture {n8} impayée|factura {n8} pendiente|lot {n6}-{n2} returned|Meeting shifted to {n1}/7.|Meeting shifted to {n2} Oct.|Visit on {year}-09-{n2}.|Workshop in week {n2}.|Webinar on {n2}/5 at 10:15.|Webinar in week {n2} at 16:00.|Lunch {year}-02-11 at 12:30.|Training {n2} Nov at 8:45.|ref. {n8}, sent {year}-01-12.|ref. XR-{n7}, sent {n2} Jan.|left in week {n2}, ref {year}-{n7}|PO {n8} waits|PO XR-{n7} signed|PO {year}-{n7} lost|P.O. {n8}|PO KD-{n7}, second copy|RMA QT-{n7} opened|SKU LM-{n6} sold out|{n3} units of ART-{n5}
to be merged?|same as another record?|could be a copy|(copy?)|please compare with the older entry|seems to be stored already|Looks like a twin.|Discount 7.5% on EUR {n2},{n3}.|Discount 3% on ${n2},{n3}.|Contract value GBP {n2},{n3}.|worth CHF {n3},{n3} a year|Came from a search engine, opened {page}.|Questionnaire en ligne, rubrique {page}.|Asked by mail for details of {product}.|Asked by mail for details of the {plan}.
Liked what we wrote on {product}.|Shared our article on the {plan}.|Filled in the form under {page}.|Search advert, arrived on {page}.|Private message about {product}.|Private message about the {plan}.|DM: {product}|DM: the {plan}|{event}: möchte Infos zu {product}.|{event}: möchte Infos zu the {plan}.|Took the {product} flyer at {event}.|Estimate E-{n6} rev {n1}.|estimate E-{n6}|Details are under {page}.|read {page}
Plant of {n4} square metres near {city}.|{n4} sqm in {city}|Dropped in at our {city} branch.|Needs {n2} licences of {product}.|Needs {n2} licences of the {plan}.|A depot in {city} is planned.|{firm} wrote once more.|Saw {firm} near {city}.|{firm} and {firm} merged|Device {n8} exchanged.|serial number {n8}|machine no. {n8} stopped|room {n3}, second floor|gate {n2}|line {n1} stopped for {n2} hours|{n2} people in {city}|from {city} to {city} in {n1} days|{city}|{product}|{event}|{firm}
"""

# Words of plain remarks, from which sentences without personal information are also put together.
_REMARK = (
    "the a this that their our no not yet still maybe soon later again twice once today tomorrow wants needs likes asks waits pays calls sends reads opens checks hopes left sent asked came went took got made saw heard found read "
    "price quote offer demo call mail form page site office desk team buyer budget order stock truck depot pallet contract renewal trial licence seat report list sheet post advert banner portal partner reseller stand booth fair "
    "new old good bad open closed late early quick slow cheap big small next last first second quarter spring summer autumn winter week month year morning evening "
    "follow-up check-in drop-off kick-off opt-in roll-out sign-off take-over walk-in add-on log-in back-up set-up start-up top-up end-of-year well-known long-term in-house e-mail pre-order co-worker full-time "
    "who which when where how why what with without from into about over under after before between during until since through against because while if then also only just very much more most less least few many some any all each every both other same such own too so than but and or as at by in of off on out up down to for is was are were be been has have had do does did will would can could may might must shall should "
    "account accountant address agenda agreement answer approval article audit batch bill board booking box brochure building business campaign card case catalogue chat click colleague comment company complaint conference contact copy cost country customer date deal delivery department discount document door email entry error event export fax field file filter finance flyer folder form freight group import inbox interest invoice issue item job key label letter level line link location machine manager market meeting member message minute mistake module money name network note notice number option owner package page paper parcel part party payment people person phone photo plan plant point policy portal post problem process product project proposal purchase question queue rate reason receipt record reference region reminder reply request response result review role room sale sample scan schedule search sector serial server service session setup shelf shipment shop side signature sign size space staff stage status step stop store story street subject supplier support survey switch system table tag target task tax test text thing ticket time tool topic total tour town track trade train traffic transfer trip type unit update user vendor version visit visitor voice volume voucher wait wall website weight wholesale work "
    "wegen mit ohne noch nicht bitte später morgen heute angebot preis termin lager firma anfrage rückmeldung unterlagen kunde wartet prüft braucht und oder "
    "avec sans encore pas plus demain devis prix rendez-vous dépôt client attend demande relance salon pour par sur le la les une des "
    "con sin todavía no más mañana oferta precio cita almacén cliente espera pide llamada feria para por el los una y o"
).split()

_SYL = "bal cor del fal gar hal jor kal lan mar nar or pal ral sal tal ul ver wes yar zor tev kes gol bren thoa gria skua plu mel od as fen sere nes dol cal mor el es".split()
_END = "berg dane dorf fors gaard hart holm land lin lund mark mull mund nek nov quist rell rud sen son stad svitz szek tala thal ti ura vane vari vel vik vitz wen win yan zano zek cion dottir müll ción dóttir ström".split()
_GIVEN = (
    "Adam Adriana Ahmed Aisha Alan Alejandro Alice Amina Anders Andrea Andrei Anna Antoine Antonio Arjun Arthur Astrid Barbara Benoît Birgit Björn Boris Brigitte Bruno Camille Carlos Caroline Catalina Cécile Chen Christian Clara Claudia Colin Cristina Daniel "
    "David Deepa Diana Diego Dieter Dmitri Dorothea Edith Eduardo Elena Elias Elisabeth Emil Emma Eric Esteban Eva Farah Felipe Fernando Florian Franz Frédéric Fumiko Gabriel George Gerd Giovanni Grace Guillaume Gunnar Hassan Heidi Helen Hiroshi Hugo Ian Igor "
    "Ilse Inés Irina Isabelle Ivan Jack Jan Javier Jean Jin-ho Joachim Johanna John Jorge Julia Kaito Karen Karl Katarzyna Kenji Klaus Kofi Laura Laurent Layla Leon Lin Lisa Louis Lucas Ludwig Luis Mae-ling Manuel Marco Margarethe Maria Marie Mark Markus Martín "
    "Mateo Max Mehmet Miguel Mohammed Monika Nadine Natalia Nils Noah Olivia Omar Pablo Paolo Patrick Peter Philippe Pilar Piotr Rachel Raj Ramón Renate Ricardo Rita Roberto Rolf Sabine Salim Sandra Sara Sebastián Sergei Simone Soo-min Stefan Susana Sven Takeshi "
    "Tatiana Thérèse Tobias Tomás Ulrike Valérie Vikram Walter Wolfgang Yasmin Yuki Yves Zeynep"
).split()
_STREET = "Alder Bishop Bridge Castle Cedar Chapel Chestnut Cobble Copper Dove Elm Falcon Ferry Garden Granary Hazel Kiln Maple Meadow Orchard Park Rectory River School Spring Thistle Tower Victoria Water Windmill".split()
_WAY = "Avenue Ave Close Court Crescent Drive Dr Gardens Grove Lane Ln Mews Parade Place Rd Road Row Square St Street Terrace Walk Way".split()
_DE = "Ahorn Amsel Bach Bahnhof Birken Dorf Eichen Feld Garten Haupt Kirch Markt Rosen Schloss Schul Wald".split()
_DEW = "weg straße strasse str. ring gasse allee platz damm ufer steig".split()
_FR = ["rue", "quai", "bd", "boulevard", "av.", "avenue", "allée", "chemin", "impasse", "place", "route"]
_FRN = ["de l'Église", "du Château", "des Acacias", "des Érables", "de la Fontaine", "de la République", "du Lac", "Victor-Hugo", "aux Herbes", "du Petit Bois"]
_ES = ["Calle", "C/", "Plaza", "Paseo", "Camino", "Avda.", "Avenida", "Ronda"]
_ESN = ["Mayor", "de la Paz", "del Río", "de los Pinos", "San Juan", "de las Flores", "de la Iglesia", "del Carmen", "Real"]
_PLAN = ["Basic plan", "Business plan", "monitoring package", "Gold plan", "export module", "trial plan"]
_EVENT_A = "Amber Bright Cedar Coastal Copper Digital Eastern Golden Granite Northern Open Orchard River Silver Summer Urban Velvet Western".split()
_EVENT_B = ["Forum", "Expo", "Conference", "Dialogue", "Festival", "Days", "Messe", "Kongress", "Summit", "Meetup", "Congress", "Symposium", "Salon", "Feria", "Roundtable", "Show"]
_EVENT_C = ["", "", "Trade ", "Logistics ", "Retail ", "Food ", "Supply ", "Energy ", "& Steel ", "of Ideas "]
_PAGE = "about team imprint blog/stock pricing/eu help downloads trial partners references news press faq terms features/maps jobs".split() + ["customer stories", "white papers"]


class Filler:
    """Invents the content of slots from a seeded generator."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def family(self) -> str:
        r = self.r
        one = lambda: (r.choice(_SYL) + (r.choice(["", "", "a", "e", "o", "i"]) + r.choice(["", r.choice(_SYL)])) + r.choice(_END)).capitalize()
        name = one()
        x = r.random()
        if x < 0.12:
            name += "-" + one()
        elif x < 0.2:
            name = r.choice(["de la ", "van ", "von ", "al-", "O'", "de ", "Mc", "el ", "di ", "van der "]) + name
        return name.replace("Od", "Öd").replace("As", "Ås") if r.random() < 0.3 else name

    def name(self) -> str:
        r = self.r
        x = r.random()
        given, family = (r.choice(_GIVEN) if x < 0.6 else f"{r.choice(_SYL).capitalize()}-{r.choice(_SYL)}" if x < 0.68 else (r.choice(_SYL) + r.choice(["a", "o", "i", "el", "ine", "us", "ah", "y", "en", "ika"])).capitalize()), self.family()
        x = r.random()
        if x < 0.1:
            given = given[0] + "."
        elif x < 0.2:
            given += " " + r.choice(_GIVEN)[0] + "."
        x = r.random()
        if x < 0.1:
            return f"{family.upper()}, {given}"
        if x < 0.16:
            return f"{family}, {given}"
        if x < 0.22:
            return f"{family.upper()} {given}"
        if x < 0.3:
            return f"{given} {family}".upper()
        if x < 0.48:
            return f"{given} {family}".lower()
        return f"{given} {family}"

    def email(self) -> str:
        r = self.r
        given, family = r.choice(_GIVEN).lower(), self.family().lower().replace(" ", "").replace("'", "")
        plain = lambda s: "".join(c for c in s if c.isascii() and c.isalpha())
        local = r.choice([f"{plain(given)}{r.choice(['.', '_', '-', ''])}{plain(family)}", f"{plain(family)}.{plain(given)}", f"{given[0]}{plain(family)}", f"{given[0]}.{plain(family)}", f"{plain(given)}{family[0]}", r.choice(["info", "sales", "office", "hello"])])
        if r.random() < 0.1:
            local += r.choice(["+news", "+q4", "+crm", self.digits(3)])
        host = r.choice(_SYL) + r.choice(_SYL) + r.choice(["on", "is", "ex", "an", "ar"])
        host = r.choice(["", "", "", "mail.", "post."]) + host + r.choice(["", "", "-agro"]) + r.choice([".example", ".test", ".invalid", ".co.example", ".com"])
        x = r.random()
        if x < 0.07:
            out = f"{local} @ {host}"
        elif x < 0.14:
            out = f"{local} (at) {host}"
        elif x < 0.21:
            out = f"{local}[at]{host.replace('.', '[dot]')}"
        elif x < 0.28:
            out = f"{local} at {host.replace('.', ' dot ')}"
        else:
            out = f"{local}@{host}"
        return out.upper() if r.random() < 0.1 else out

    def phone(self) -> str:
        r, d = self.r, self.digits
        cc = "2" + d(2)
        return r.choice([f"+{cc}{d(9)}", f"+{cc} {d(2)} {d(3)} {d(4)}", f"+{cc} {d(2)} {d(2)} {d(2)} {d(3)}", f"+{cc} {d(2)} {d(2)} {d(3)} {d(2)}", f"+{cc} (0){d(3)}.{d(3)}.{d(3)}", f"{cc}{d(9)}", f"00{cc}-{d(3)}-{d(6)}", f"0{d(2)}/{d(3)} {d(2)} {d(2)}", f"0{d(4)} {d(5)}", f"(0{d(2)}) {d(3)}-{d(4)}", f"0{d(3)}/{d(6)}", f"+{cc}-{d(4)}.{d(5)}"])

    def id_number(self) -> str:
        r, d = self.r, self.digits
        a = lambda n: "".join(r.choice("ABCDEFGHKLMNPRSTVXZ") for _ in range(n))
        return r.choice([f"{a(2)} {d(3)} {d(4)}", f"{d(8)}{a(1)}", f"{d(2)}.{d(3)}.{d(3)}-{a(1)}", f"{d(2)}-{d(7)}", f"666-{d(2)}-{d(4)}", f"{d(6)}-{d(4)}", f"{a(1)}{d(7)}", f"{a(2)}{d(6)}{a(1)}"])

    def address(self) -> str:
        r = self.r
        n, city, code = str(r.randint(1, 240)), self.city(), self.digits(5)
        x = r.random()
        new = lambda: (r.choice(_SYL) + r.choice(["", r.choice(_SYL)]) + r.choice(["", "o", "a", "os", "es", "s"])).capitalize()
        if x < 0.5:
            out = f"{n} {r.choice(['', '', '', 'Old ', 'Upper '])}{r.choice(_STREET) if r.random() < 0.6 else new()} {r.choice(_WAY)}"
            bare = r.random() < 0.4
            if not bare:
                out += ("." if out.endswith(" St") and r.random() < 0.7 else "") + f", {city}" + r.choice(["", f" {self.digits(4)}"])
            if r.random() < 0.2:
                out = f"Flat {r.randint(1, 8)}, {out}"
        elif x < 0.66:
            out = f"{r.choice(_DE) if r.random() < 0.6 else new()}{r.choice(_DEW)} {n}, {code} {city}"
        elif x < 0.83:
            out = f"{n} {r.choice(_FR)} {r.choice(_FRN) if r.random() < 0.4 else r.choice(['du ', 'des ', 'de la ', 'de ', 'du Vieux ', 'du Grand ']) + new()}, {code} {city}"
        else:
            out = f"{r.choice(_ES)} {r.choice(_ESN) if r.random() < 0.4 else r.choice(['de la ', 'del ', 'de los ', 'de las ', 'de el ', 'la ', 'las ', 'los ', '']) + new()} {n}, {code} {city}"
        return out.lower() if r.random() < 0.2 else out

    def city(self) -> str:
        r = self.r
        one = lambda: (r.choice(_SYL) + r.choice(["", r.choice(_SYL)]) + r.choice(["ville", "moor", "ford", "field", "haven", "bridge", "burg", "brück", "tal", "wede", "vaara", "vik", "sund", "mont", "rive", "nella", "ermo", "alba", "wick", "holm", "stad"])).capitalize()
        x = r.random()
        return f"{r.choice(['Saint', 'Puerto', 'Bad', 'Villa', 'Port'])}-{one()}" if x < 0.14 else f"{one()}-{r.choice(['Sur', 'Nord', 'Plage', 'West', 'Haut'])}" if x < 0.2 else one()

    def product(self) -> str:
        r = self.r
        part = lambda: (r.choice(_SYL) + r.choice(_SYL)).capitalize() if r.random() < 0.4 else r.choice("Cash Cargo Data Fleet Flow Grid Hub Lane List Map Pack Plan Port Pulse Scan Shift Spot Trace View Work".split())
        return part() + part()

    def event(self) -> str:
        r = self.r
        return f"{r.choice(_EVENT_A)} {r.choice(_EVENT_C)}{r.choice(_EVENT_B)}" + r.choice(["", "", "", f" {r.randint(2021, 2028)}"])

    def remark(self) -> str:
        r = self.r
        text = " ".join(r.choice(_REMARK) for _ in range(r.randint(2, 7)))
        return (text.capitalize() if r.random() < 0.6 else text) + r.choice([".", ".", "", "?"])

    def words(self) -> str:
        r = self.r
        text = " ".join(r.choice(_REMARK) if r.random() < 0.95 else r.choice(_REMARK).capitalize() for _ in range(r.randint(1, 4)))
        return text[:1].upper() + text[1:] if r.random() < 0.4 else text

    def firm(self) -> str:
        r = self.r
        return f"{(r.choice(_SYL) + r.choice(_SYL) + r.choice(['on', 'ex', 'is'])).capitalize()} {r.choice(['Freight', 'Foods', 'Optics', 'Retail'])} {r.choice(['Ltd', 'AG', 'Oy', 'Inc'])}"

    def slot(self, kind: str) -> str:
        r = self.r
        if kind in KINDS:
            return getattr(self, kind.lower())()
        if kind[0] == "n" and kind[1:].isdigit():
            return self.digits(int(kind[1:])).lstrip("0") if int(kind[1:]) < 5 and r.random() < 0.9 else self.digits(int(kind[1:]))
        return {"product": self.product, "plan": lambda: r.choice(_PLAN), "event": self.event, "page": lambda: r.choice(_PAGE), "city": self.city, "firm": self.firm, "remark": self.remark, "words": self.words, "year": lambda: str(r.randint(2023, 2028))}[kind]()


def _frames(text: str) -> list[str]:
    return [f for line in text.strip().splitlines() for f in line.replace(" | ", "\x00").split("|") if f]


def labelled_notes(size: int = 2400, seed: int = 5, held_out: bool | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """`size` notes, each with the spans (start, end, kind) of its personal information. The size is the bound of the table.

    held_out: None for all frames; True for every fifth frame alone, False for all others, so that a test meets sentences that were never learned.
    """
    pick = lambda frames: [f for i, f in enumerate(frames) if held_out is None or (i % 5 == 4) == held_out]
    fill, personal, plain, out = Filler(seed), pick(_frames(FRAMES)), [*pick(_frames(PLAIN)), *["{remark}", "{words} {n5} {words}", "{words} {n8}", "{words} {year}-{n7}", "{words} AB-{n6} {words}", "{words} {city} {words}", "{words} {event}", "{words} {product}", "{firm} {words}"] * 5], []
    r = fill.r
    for k in range(size):
        frames = [personal[k % len(personal)] if r.random() < 0.8 else r.choice(plain)] + [r.choice(plain) if r.random() < 0.8 else r.choice(personal) for _ in range(r.choice([0, 1, 1, 2, 3]))]
        r.shuffle(frames)
        joint = r.choice([" ", " ", " / ", "\n", " - "])
        text, spans = "", []
        for i, frame in enumerate(frames):
            text += joint if i else ""
            for j, piece in enumerate(frame.replace("\x00", " | ").replace("}", "{").split("{")):
                if j % 2:
                    value = fill.slot(piece)
                    if piece in KINDS:
                        spans.append((len(text), len(text) + len(value), piece))
                    text += value
                else:
                    text += piece
        out.append((text, spans))
    return out
