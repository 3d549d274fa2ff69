"""Word lists, profiles and bounds that results depend on."""

# Amenity words of a description.
AMENITIES = {
    "parking": ["parking", "garage"],
    "piscine": ["piscine", "pool"],
    "standing": ["standing", "luxe", "prestige"],
    "neuf": ["neuf", "nouvelle construction"],
    "terrasse": ["terrasse", "balcon"],
    "jardin": ["jardin", "garden"],
    "ascenseur": ["ascenseur"],
    "climatise": ["climatise", "climatisation"],
    "securise": ["gardiennage", "securise", "residence fermee", "residence securisee"],
    "meuble": ["meuble", "furnished"],
    "vue_mer": ["vue mer", "bord de mer"],
    "renove": ["renove", "refait", "renovation", "remis a neuf"],
}

# Words of rent and of sale.
RENT_WORDS = ["location", "locat", "à louer", "a louer", "louer", "rent", "loue", "à la location", "courte duree", "courte durée", "saisonnier", "saisonniere", "vacances", "vacance", "meublé", "meuble", "meublée", "airbnb", "nuitée", "nuitee", "par mois", "par nuit", "mensuel", "mensuelle", "loyer"]
SALE_WORDS = ["vente", "à vendre", "a vendre", "vendre", "achat", "cession", "vend", "mise en vente", "sale", "for sale", "cède", "cede"]

# Property types by words of a description, first match wins.
TYPE_WORDS = {
    "Appartement": ["appartement", "appart", "studio", "duplex"],
    "Maison": ["maison", "bungalow", "dar"],
    "Villa": ["villa"],
    "Chambre": ["chambre a louer", "colocation"],
    "Local Commercial": ["local commercial", "fonds de commerce", "boutique"],
    "Bureau": ["bureau", "office"],
    "Terrain": ["terrain", "parcelle"],
    "Ferme": ["ferme", "agricole", "oliveraie"],
}
SEGMENT = {"Appartement": "Residentiel", "Maison": "Residentiel", "Villa": "Residentiel", "Chambre": "Residentiel", "Terrain": "Foncier", "Ferme": "Foncier", "Local Commercial": "Commercial", "Bureau": "Commercial", "Divers": "Divers"}

# Fixed values: (segment, least rent, most rent, least price, most price, least surface, most surface).
BOUNDS = [
    ("Residentiel", 150.0, 25_000.0, 15_000.0, 20_000_000.0, 10.0, 2_000.0),
    ("Foncier", 200.0, 500_000.0, 5_000.0, 50_000_000.0, 50.0, 5_000_000.0),
    ("Commercial", 300.0, 500_000.0, 5_000.0, 20_000_000.0, 10.0, 50_000.0),
    ("Divers", 50.0, 50_000.0, 200.0, 500_000.0, 5.0, 2_000.0),
]

# Fixed values: (transaction, type, slope, half-life in days, cap) of the pressure to sell; 1 is rent, 2 sale.
PRESSURE = [
    (1, "Appartement", 0.045, 21.0, 0.09),
    (1, "Chambre", 0.050, 14.0, 0.10),
    (1, "Maison", 0.040, 28.0, 0.08),
    (1, "Villa", 0.035, 35.0, 0.07),
    (2, "Appartement", 0.030, 45.0, 0.08),
    (2, "Maison", 0.025, 60.0, 0.06),
    (2, "Villa", 0.020, 75.0, 0.05),
    (2, "Terrain", 0.040, 30.0, 0.12),
    (2, "Ferme", 0.045, 30.0, 0.13),
    (2, "Local Commercial", 0.030, 45.0, 0.10),
    (2, "Bureau", 0.030, 45.0, 0.10),
    (2, "Chambre", 0.030, 45.0, 0.08),
]
PRESSURE_DEFAULT = (0.030, 45.0, 0.08)

# Fixed values: (index change above, base discount), and the discount otherwise.
DISCOUNT_STEPS, DISCOUNT_LEAST_GROWTH = [(10.0, 0.03), (5.0, 0.05), (2.0, 0.07)], 0.09

# Clauses of a contract and the words that show them.
CLAUSES = {
    "تعريف الأطراف": ["المسوغ", "المتسوغ", "البائع", "المشتري", "الواعد", "الوكيل", "الممضين"],
    "موضوع العقد": ["المحل الكائن", "قطعة الأرض", "العقار", "المنزل", "المحل"],
    "المدة": ["لمدة", "سنة", "أشهر", "مدة التسويغ", "تبتدئ", "تنتهي"],
    "الثمن/المقدار": ["مقدار", "دينار", "ثمن", "مبلغ", "درهم"],
    "الدفع": ["دفع", "مسبقا", "دفعة", "تسبيق", "عربون", "مقابل وصل"],
    "التسليم": ["تسلم", "تسليم", "حالة حسنة", "لوازمه", "مفاتيح"],
    "الضمان/الكفالة": ["ضمان", "كفالة", "مبلغ ضمان"],
    "الفسخ": ["فسخ", "وجوبا", "فسخ هذا العقد", "ينفسخ"],
    "الإشعار المسبق": ["إشعار", "إعلام", "شهرين", "شهر على الأقل", "تنبيه"],
    "التسويغ للغير": ["للغير", "إعارته", "التسويغ الفرعي"],
    "المعاليم/الضرائب": ["معاليم الشؤون", "الاداءات البلدية", "ضريبة", "أداء"],
    "الإصلاحات": ["إصلاحات", "تحسينات", "تغيير بالمحل"],
    "ماء/كهرباء": ["الماء والكهرباء", "عدادين", "فواتير", "استهلاك"],
    "الكرامة": ["غير لائق بالكرامة", "السيرة السيئة"],
    "التفقد": ["تفقد المحل", "من ينوبه"],
    "الترفيع": ["الترفيع", "ترفيع في الايجار"],
    "الشهود": ["شاهد", "شاهدين", "شهود"],
    "التسجيل الرسمي": ["تسجيل", "كاتب عدل", "قباضة التسجيل", "الشهر العقاري"],
    "خلو من الرهن": ["خلو", "رهن", "خالص", "قيد"],
    "العربون": ["عربون", "تسبيق"],
    "أجل البيع النهائي": ["البيع النهائي", "أجل", "لا يتجاوز موعد"],
    "الصلاحيات": ["صلاحيات", "التصرف الكامل", "التفويض"],
    "شروط الإلغاء": ["إلغاء الوكالة", "شروط الإلغاء", "إلغاء هذا العقد"],
    "أجل الوكالة": ["أجل الوكالة", "مدة الوكالة", "لمدة سنة"],
}

# Clauses that a contract of each subtype must have; other subtypes count as a lease.
MANDATORY = {
    "كراء": ["تعريف الأطراف", "موضوع العقد", "المدة", "الثمن/المقدار", "الدفع", "التسليم", "الفسخ", "المعاليم/الضرائب"],
    "بيع": ["تعريف الأطراف", "موضوع العقد", "الثمن/المقدار", "الدفع", "التسجيل الرسمي", "خلو من الرهن", "الشهود"],
    "وعد": ["تعريف الأطراف", "موضوع العقد", "الثمن/المقدار", "العربون", "أجل البيع النهائي", "التسجيل الرسمي"],
    "وكالة": ["تعريف الأطراف", "موضوع العقد", "الصلاحيات", "أجل الوكالة", "شروط الإلغاء"],
}
LEASE = "كراء"

# Labels of a legal passage and their words, first match wins; the label without any.
LEGAL_LABELS = {
    "عقوبة/جزاء": ["بطلان", "عقوبة", "غرامة", "سجن", "جريمة", "مخالفة", "nullité", "sanction", "amende", "peine"],
    "التزام قانوني": ["يجب", "يلتزم", "موافقة", "ترخيص", "إذن", "إلزامية", "يوجب", "يستوجب", "واجب", "obligation", "doit", "autorisation requise"],
    "إجراء رسمي": ["تسجيل", "توثيق", "كاتب عدل", "قباضة", "شهر عقاري", "نشر", "إيداع", "تقييد", "enregistrement", "notaire", "publication"],
    "شرط/حالة": ["في حالة", "إذا", "شريطة", "بشرط", "ما لم", "si", "sous réserve", "à condition"],
    "نص قانوني رسمي": ["مرسوم", "قانون", "أمر", "قرار", "منشور", "تعليمة", "décret", "loi", "arrêté", "circulaire"],
}
LEGAL_DEFAULT = "معلومة عامة"

# Words before a city, words of a relative date, cities looked for in long addresses.
CITY_PREFIXES = ["location de vacances ", "location ", "vente ", "à louer ", "a louer ", "à vendre ", "a vendre "]
RELATIVE_WORDS = ["month", "day", "week", "hour", "minute", "ago", "just now"]
ADDRESS_CITIES = ["hammamet", "hammam sousse", "tunis", "sfax", "sousse", "nabeul", "ariana", "monastir", "bizerte", "mahdia", "djerba", "la marsa", "kairouan"]

# What is no city, and cities written wrongly.
NO_CITIES = ["non spcifi", "non specifi", "non spécifié", "la", "louer", "vendre", "inconnu", "autre", "", "none", "nan", "tunisie", "tunisia"]
CITY_TYPOS = {
    "nabul": "nabeul",
    "nabel": "nabeul",
    "nbeul": "nabeul",
    "mgrine": "megrine",
    "mégrine": "megrine",
    "kala kebira": "kalaa kebira",
    "kala sghira": "kalaa sghira",
    "cit el khadra": "cite el khadra",
    "cit el wafa afh 2": "cite el wafa",
    "cite el wafa afh2": "cite el wafa",
    "kairouan ville": "kairouan",
    "ariana ville": "ariana",
    "sfax ville": "sfax",
    "sousse ville": "sousse",
    "monastir ville": "monastir",
    "mahdia ville": "mahdia",
    "gammarth sup": "gammarth",
    "gammarth superieur": "gammarth",
    "sidi bou ali sousse": "sidi bou ali",
    "location tunis": "tunis",
    "vente tunis": "tunis",
    "sahloul": "sahloul",
    "klibia": "kelibia",
    "khezama est": "khezama est",
    "khezama ouest": "khezama ouest",
}

# Regions in the order in which they are looked for.
REGIONS = ["Tunis", "Ariana", "Ben Arous", "Manouba", "Nabeul", "Zaghouan", "Bizerte", "Béja", "Jendouba", "Kef", "Siliana", "Kairouan", "Kasserine", "Sidi Bouzid", "Sousse", "Monastir", "Mahdia", "Sfax", "Gafsa", "Tozeur", "Kebili", "Gabès", "Medenine", "Tataouine"]

# Quality of pictures by source, first match wins.
SOURCE_QUALITY = {"century21": 0.95, "homeintunisia": 0.90, "mubawab": 0.85, "tayara": 0.70, "tunisie annonces": 0.65, "mubawab partial": 0.75, "facebook marketplace": 0.50, "bnb": 0.75}

# The central bank's rate by (year, quarter).
RATES = {(2022, 1): 6.25, (2022, 2): 6.25, (2022, 3): 7.00, (2022, 4): 8.00, (2023, 1): 8.00, (2023, 2): 8.00, (2023, 3): 8.00, (2023, 4): 8.00, (2024, 1): 7.50, (2024, 2): 7.50, (2024, 3): 7.50, (2024, 4): 7.25, (2025, 1): 7.25, (2025, 2): 7.00, (2025, 3): 7.00, (2025, 4): 7.00}

# Shares of (year, quarter) among the listings without a date.
DATE_SHARES = {
    (2022, 1): 0.004, (2022, 2): 0.005, (2022, 3): 0.005, (2022, 4): 0.006,
    (2023, 1): 0.007, (2023, 2): 0.008, (2023, 3): 0.008, (2023, 4): 0.007,
    (2024, 1): 0.010, (2024, 2): 0.012, (2024, 3): 0.013, (2024, 4): 0.015,
    (2025, 1): 0.060, (2025, 2): 0.080, (2025, 3): 0.120, (2025, 4): 0.180,
    (2026, 1): 0.460,
}

# Levels of density and the level of other words; population above which a city is high, medium.
LEVELS, LEVEL_DEFAULT = {"very_high": 5, "high": 4, "medium": 3, "low": 2, "very_low": 1}, 3
POPULATION_STEPS = [(200_000, "high"), (50_000, "medium")]

# Least and most price a square metre by segment, of other segments; least and most change of prices.
PRICE_M2_BOUNDS, PRICE_M2_OTHER = {"residentiel": (10, 8000), "foncier": (5, 3000), "commercial": (20, 15000), "divers": (5, 10000)}, (5, 10000)
CHANGE_BOUNDS = (-50, 200)

# Months of the high season where too few dates are known.
HIGH_SEASON = [3, 4, 5, 9, 10, 11]

# Accented Latin letters and their plain forms.
ACCENTED, PLAIN = "àâäáãåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

# Phrases of listings and what they are replaced by; of equal length the first goes first.
PHRASES = {
    "s+0": "studio",
    "s+1": "appartement une chambre",
    "s+2": "appartement deux chambres",
    "s+3": "appartement trois chambres",
    "s+4": "appartement quatre chambres",
    "s+5": "appartement cinq chambres",
    "dar arabiya": "maison arabe standing heritage",
    "dar": "maison",
    "villa prestige": "villa luxe standing haut gamme",
    "standing": "luxe haut gamme prestige",
    "rdc": "rez de chaussee",
    "duplex": "duplex deux niveaux",
    "triplex": "triplex trois niveaux",
    "penthouse": "penthouse dernier etage luxe",
    "pieds dans l eau": "bord mer front mer vue mer luxe",
    "bord de mer": "vue mer front mer littoral",
    "vue panoramique lac": "berges du lac luxe vue lac",
    "berges du lac": "berges lac tunis luxe standing",
    "les berges": "berges lac luxe",
    "sidi bou said": "sidi bou said luxe village artistique",
    "gammarth": "gammarth zone luxe prestige",
    "la marsa": "la marsa balneare prestige",
    "jardins de carthage": "jardins carthage luxe residence",
    "kantaoui": "port el kantaoui touristique mer",
    "yasmine hammamet": "yasmine hammamet zone touristique luxe",
    "djerba": "djerba ile touristique mer",
    "bien expose": "orientation soleil lumineux",
    "tres lumineux": "lumineux ensoleille",
    "entierement renove": "renove neuf etat neuf",
    "cle en main": "pret habiter etat neuf",
    "neuf jamais habite": "neuf etat parfait",
    "residence fermee": "residence securisee gardiennage standing",
    "residence securisee": "securite gardiennage standing",
    "avec piscine": "piscine luxe",
    "pied dans l eau": "bord mer luxe",
    "vue sur mer": "vue mer premium",
    "double vitrage": "isolation qualite construction",
    "climatisation centralisee": "climatisation luxe",
    "domotique": "domotique smart home luxe",
    "ascenseur": "ascenseur immeuble standing",
    "parking couvert": "parking garage securise",
    "cave": "cave stockage",
    "terrasse panoramique": "terrasse vue panoramique luxe",
    "prix negociable": "prix flexible negociation",
    "prix ferme": "prix fixe pas negociation",
    "urgent": "vente urgente prix bas",
    "investissement": "investissement rentabilite",
    "rendement locatif": "rentabilite location investissement",
    "haouma": "quartier voisinage",
    "houma": "quartier",
    "dar el baraka": "maison benediction standing",
    "cite el wafa": "cite el wafa quartier",
    "cite ennasr": "cite ennasr quartier",
}

# Words of property types, in their order.
TYPE_NAMES = {
    "appartement": "Appartement",
    "appart": "Appartement",
    "studio": "Appartement",
    "duplex": "Appartement",
    "triplex": "Appartement",
    "penthouse": "Appartement",
    "s+1": "Appartement",
    "s+2": "Appartement",
    "s+3": "Appartement",
    "s+4": "Appartement",
    "s+5": "Appartement",
    "rdc": "Appartement",
    "maison": "Maison",
    "house": "Maison",
    "dar": "Maison",
    "bungalow": "Maison",
    "villa": "Villa",
    "propriete": "Villa",
    "chalet": "Villa",
    "chambre": "Chambre",
    "room": "Chambre",
    "colocation": "Chambre",
    "local": "Local Commercial",
    "commerce": "Local Commercial",
    "boutique": "Local Commercial",
    "magasin": "Local Commercial",
    "hangar": "Local Commercial",
    "entrepot": "Local Commercial",
    "showroom": "Local Commercial",
    "fonds de commerce": "Local Commercial",
    "bureau": "Bureau",
    "office": "Bureau",
    "open space": "Bureau",
    "coworking": "Bureau",
    "terrain": "Terrain",
    "lot": "Terrain",
    "lotissement": "Terrain",
    "parcelle": "Terrain",
    "foncier": "Terrain",
    "ferme": "Ferme",
    "agricole": "Ferme",
    "oliveraie": "Ferme",
    "verger": "Ferme",
    "exploitation": "Ferme",
    "champ": "Ferme",
}
