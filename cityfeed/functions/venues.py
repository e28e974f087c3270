"""Venues whose place is known."""

#: Fixed values, in the order of lookup: keyword, latitude, longitude, address.
KNOWN_VENUES = [
    ("zollverein", 51.4864, 7.0403, "Gelsenkirchener Str. 181, 45309 Essen"),
    ("ruhr museum", 51.4864, 7.0403, "Gelsenkirchener Str. 181, 45309 Essen"),
    ("red dot", 51.4857, 7.0378, "Klemmannstr. 3, 45329 Essen"),
    ("halle 8", 51.4829, 7.0325, "Kronprinzenstr. 8, 45128 Essen"),
    ("pact", 51.4848, 7.0389, "Bullmannaue 11, 45329 Essen"),
    ("stiftung zollverein", 51.4864, 7.0403, "Gelsenkirchener Str. 181, 45309 Essen"),
    ("unesco-welterbe zollverein", 51.4864, 7.0403, "Gelsenkirchener Str. 181, 45309 Essen"),
    ("lichtburg", 51.4549, 7.0136, "Lichtburg Essen, Kettwiger Str. 36, 45127 Essen"),
    ("grillo-theater", 51.4516, 7.0133, "Friedrichstr. 55, 45128 Essen"),
    ("grillo theater", 51.4516, 7.0133, "Friedrichstr. 55, 45128 Essen"),
    ("aalto-theater", 51.4469, 7.0127, "Aalto-Theater, Opernplatz 10, 45128 Essen"),
    ("stadtpark", 51.4891, 7.0105, "Stadtpark 1, 45131 Essen"),
    ("zeche carl", 51.4965, 7.0124, "Zeche Carl, Wilhelm-Nieswandt-Allee 100, 45326 Essen-Altenessen"),
    ("villa hügel", 51.4069, 7.0090, "Villa Hügel, Hügel 1, 45133 Essen-Bredeney"),
    ("maschinenhaus", 51.4965, 7.0124, "Maschinenhaus Essen, Wilhelm-Nieswandt-Allee 100, 45326 Essen-Altenessen"),
    ("studio-bühne", 51.4651, 7.0962, "Studio-Bühne Essen, Korumhöhe 11, 45307 Essen-Kray"),
    ("studio bühne", 51.4651, 7.0962, "Studio-Bühne Essen, Korumhöhe 11, 45307 Essen-Kray"),
    ("studio-buehne", 51.4651, 7.0962, "Studio-Bühne Essen, Korumhöhe 11, 45307 Essen-Kray"),
    ("weststadthalle", 51.4438, 7.0632, "Weststadthalle, Bebelplatz 1, 45128 Essen"),
    ("philharmonie", 51.4516, 7.0133, "Philharmonie Essen, Huyssenallee 41, 45128 Essen"),
    ("goethebunker", 51.4567, 7.0098, "Goethebunker, 45128 Essen"),
    ("turock", 51.4615, 7.0138, "Turock, Viehofer Platz 3, 45127 Essen"),
    ("rabbit hole", 51.4617, 7.0145, "Rabbit Hole Theater, Viehofer Platz 19, 45127 Essen"),
    ("theater courage", 51.4388, 7.0023, "Theater Courage, Goethestr. 67, 45130 Essen-Rüttenscheid"),
    ("courage", 51.4388, 7.0023, "Theater Courage, Goethestr. 67, 45130 Essen-Rüttenscheid"),
    ("atelierhaus", 51.4587, 7.0142, "Atelierhaus Schützenbahn, Schützenbahn 19, 45127 Essen"),
    ("schützenbahn", 51.4587, 7.0142, "Atelierhaus Schützenbahn, Schützenbahn 19, 45127 Essen"),
    ("folkwang", 51.4473, 7.0593, "Goethestr. 41, 45128 Essen"),
    ("grugapark", 51.4293, 7.0561, "Virchowstr. 4, 45147 Essen"),
    ("gruga", 51.4293, 7.0561, "Grugapark, Virchowstr. 4, 45147 Essen"),
    ("grugahalle", 51.4293, 7.0561, "Grugahalle, Virchowstr. 4, 45147 Essen"),
    ("kulturforum", 51.4364, 7.0193, "Kulturforum Steele, 45276 Essen"),
    ("tck", 51.4638, 7.0125, "Turnclub 1888 Essen e.V., 45128 Essen"),
    ("dance4water", 51.4503, 7.0220, "Dance4Water, Friedrich-Ebert-Str. 23, 45127 Essen"),
    ("grend kulturzentrum", 51.4376, 7.0816, "GREND Kulturzentrum, Westfalenstr. 311, 45276 Essen"),
    ("grendtheater", 51.4376, 7.0816, "GRENDTheater, Westfalenstr. 311, 45276 Essen"),
    ("grend", 51.4376, 7.0816, "GREND Kulturzentrum, Westfalenstr. 311, 45276 Essen"),
    ("freak show", 51.4602, 7.0148, "FREAK SHOW Rock'n'Roll Bar, Heinickestr. 8, 45128 Essen"),
    ("szene 10", 51.4543, 7.0050, "Szene 10 - Bühne im Girardet, Hindenburgstr. 67, 45127 Essen"),
    ("girardet", 51.4543, 7.0050, "Girardethaus, Hindenburgstr. 67, 45127 Essen"),
    ("orbit", 51.4513, 7.0107, "Orbit (Schalthaus 2), 45127 Essen"),
    ("schalthaus", 51.4513, 7.0107, "Schalthaus 2, 45127 Essen"),
    ("seaside beach baldeney", 51.3977, 7.0361, "Seaside Beach Baldeneysee, Freiherr-vom-Stein-Str. 386a, 45133 Essen"),
    ("seaside beach", 51.3977, 7.0361, "Seaside Beach Baldeneysee, 45133 Essen"),
    ("essen metro", 51.4280, 7.0660, "Metro Essen, Norbertstr. 100, 45131 Essen"),
    ("drive in autokino", 51.4280, 7.0660, "DRIVE IN Autokino, Sulterkamp 70, 45356 Essen"),
    ("autokino essen", 51.5020, 6.9970, "Autokino Essen, Sulterkamp 70, 45356 Essen"),
    ("om club", 51.4543, 7.0070, "OM Club, Vereinsstr. 14, 45127 Essen"),
    ("faces bar", 51.4543, 7.0080, "FACES Bar, 45127 Essen"),
    ("gentlem", 51.4543, 7.0080, "gentleM Essen, 45127 Essen"),
    ("cozycourt", 51.4543, 7.0090, "CozyCourt Essen, 45127 Essen"),
    ("kula yoga", 51.4543, 7.0090, "Kula Yoga Studio, 45127 Essen"),
    ("ikea essen", 51.4170, 7.0860, "IKEA Essen, Frohnhauser Str. 297, 45144 Essen"),
    ("hirschlandplatz", 51.4534, 7.0156, "Hirschlandplatz, 45127 Essen"),
    ("donnerberg", 51.3838, 7.0411, "Donnerberg, 45239 Essen"),
    ("bonnekamphöhe", 51.5043, 7.0530, "Naturgarten Bonnekamphöhe, Bonnekampstr., 45327 Essen"),
    ("bonnekamphoehe", 51.5043, 7.0530, "Naturgarten Bonnekamphöhe, Bonnekampstr., 45327 Essen"),
    ("adolf-clarenbach-kirche", 51.3870, 7.0470, "Adolf-Clarenbach-Kirche, Heisinger Str., 45239 Essen-Heisingen"),
    ("st. gertrud", 51.4564, 7.0135, "St. Gertrud, Rottstr., 45127 Essen"),
    ("zeche bonifacius", 51.4570, 7.0980, "Zeche Bonifacius, Schurenbachstr., 45329 Essen"),
    ("umformerhalle", 51.4570, 7.0980, "Umformerhalle Zeche Bonifacius, 45329 Essen"),
    ("co-working praxis", 51.4543, 7.0100, "Co-Working Praxis ZEITRAUMplus, 45127 Essen"),
    ("zeitraumplus", 51.4543, 7.0100, "ZEITRAUMplus, 45127 Essen"),
    ("denkmal steile lagerung", 51.4864, 7.0403, "Denkmal Steile Lagerung, Zollverein, 45309 Essen"),
    ("albert-schweitzer-tierheim", 51.4696, 7.0093, "Albert-Schweitzer-Tierheim, Grillostr. 24, 45141 Essen"),
    ("tierheim essen", 51.4696, 7.0093, "Albert-Schweitzer-Tierheim, Grillostr. 24, 45141 Essen"),
    ("essen hauptbahnhof", 51.4515, 7.0133, "Essen Hauptbahnhof, 45127 Essen"),
    ("messe essen", 51.4287, 6.9944, "Messe Essen, Messeplatz, 45131 Essen"),
    ("domschatzkammer", 51.4557, 7.0139, "Domschatzkammer, Burgplatz 2, 45127 Essen"),
    ("domschatz essen", 51.4557, 7.0139, "Domschatzkammer, Burgplatz 2, 45127 Essen"),
    ("kunsthaus essen", 51.4258, 7.0532, "Kunsthaus Essen, Rübezahlstr. 33, 45134 Essen-Rellinghausen"),
    ("katakomben-theater", 51.4308, 7.0062, "Katakomben Theater, Steile Str. 1, 45147 Essen"),
    ("katakomben theater", 51.4308, 7.0062, "Katakomben Theater, Steile Str. 1, 45147 Essen"),
    ("neoliet", 51.4479, 6.9870, "Boulderbar Neoliet, Münchener Str. 106a, 45145 Essen-Holsterhausen"),
    ("element boulders", 51.4553, 6.9854, "Element Boulders Essen, Haedenkampstr. 73, 45143 Essen-Altendorf"),
    ("hespertalbahn", 51.3883, 7.0618, "Hespertalbahn, Kupferdreh, 45257 Essen"),
    ("ruhrverband kläranlage kupferdreh", 51.3943, 7.0787, "Ruhrverband Kläranlage Essen-Kupferdreh, Kampmannbrücke 11, 45257 Essen"),
    ("musikpalette", 51.4537, 7.0131, "Musikpalette (MuPa), Kettwiger Str. 20, 45127 Essen"),
    ("neue musik zentrale", 51.4617, 7.0147, "Neue Musik Zentrale, Viehofer Platz 18, 45127 Essen"),
]
