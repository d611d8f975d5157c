"""Spending categories by keyword."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.keywords import lookup, prefixes, with_words
from tallyforge.functions.text import quote

Rules = tuple[tuple[str, tuple[str, ...]], ...]

# Keywords per category; a keyword may occur anywhere in the description, the first category wins.
GROCERIES = """
walmart, target, safeway, kroger, whole foods, trader joe, aldi, costco, sam's club, publix, wegmans, food lion,
stop & shop, giant, king soopers, king sooper, kings, shoprite, heb, h-e-b, ralphs, vons, albertsons, fred meyer, qfc,
smith's, food 4 less, jewel-osco, acme, shop n save, shop'n save, hy-vee, meijer, winn-dixie, bi-lo, harris teeter,
ingles, weis, giant eagle, market basket, price chopper, hannaford, shoppers, save-a-lot, lidl, sprouts, fresh market,
food, grocery, supermarket, market, grocery store
"""
RESTAURANTS = """
mcdonald, burger king, bk, wendy, taco bell, kfc, subway, starbucks, dunkin, dunkin donuts, pizza hut, domino, dominos,
papa john, chipotle, panera, olive garden, applebees, chili, outback, red lobster, five guys, in-n-out, shake shack,
arby, sonic, jack in the box, white castle, carl's jr, hardee, whataburger, culver, popeyes, chick-fil-a, chickfila,
bojangles, zaxby, raising cane, little caesar, papa murphy, california pizza, buffalo wild wings, bw3, wingstop, qdoba,
moe's, cava, sweetgreen, jamba, smoothie king, dairy queen, dq, baskin robbins, cold stone, ihop, denny, waffle house,
cracker barrel, red robin, boston market, restaurant, cafe, coffee, diner, bistro, grill, bar & grill, food truck,
uber eats, doordash, grubhub, postmates, delivery, fast food, takeout, take out
"""
GAS = """
shell, exxon, mobil, bp, chevron, texaco, arco, valero, citgo, sunoco, phillips 66, conoco, marathon, speedway,
7-eleven, 7eleven, circle k, quiktrip, qt, wawa, sheetz, casey's, caseys, kum & go, kum and go, love's, loves, pilot,
flying j, ta travel, racetrac, murphy usa, costco gas, sam's club gas, sams club gas, kroger fuel, safeway fuel,
gas station, fuel, gas, petrol, filling station, service station
"""
UTILITIES = """
electric, power, gas company, water, sewer, trash, waste, utility, duke energy, pg&e, southern california edison,
con edison, comcast, xfinity, verizon, at&t, t-mobile, sprint, internet, cable, phone bill, cell phone
"""
SUBSCRIPTIONS = """
netflix, spotify, amazon prime, hulu, disney, apple music, youtube premium, hbo, max, paramount, peacock, audible,
adobe, microsoft 365, office 365, dropbox, icloud, google drive, subscription, monthly, annual, recurring
"""
SHOPPING = """
amazon, ebay, etsy, walmart.com, target.com, best buy, home depot, lowes, macy, nordstrom, kohl, jcpenney, sears,
dillard, belk, online purchase, shop, retail, store purchase, gamestop, barnes & noble
"""
PETS = "petco, petsmart, pet store, pet supply, veterinary, vet, pet care, animal hospital"
AUTO_PARTS = """
autozone, advance auto, oreilly, napa, auto parts, car parts, automotive, pep boys, carquest
"""
VEHICLE_MAINTENANCE = """
jiffy lube, valvoline, quick lube, oil change, lube, discount tire, firestone, goodyear, bridgestone, michelin, ntb,
national tire, big o tire, les schwab, town fair tire, tire kingdom, mr tire, tire, tires, tire shop, car wash,
carwash, auto wash, mister car wash, zipper car wash, auto repair, mechanic, auto service, car service,
vehicle service, auto body, body shop, collision, auto body shop, emissions test, smog check, emissions, smog, dmv,
department of motor vehicles, vehicle registration, registration, license plate, tags, aaa, triple a,
roadside assistance, towing, tow, brake, brakes, transmission, engine, battery, alternator, oil change, tune up,
inspection, state inspection, dealer service, dealership, ford service, chevrolet service, chevy service,
toyota service, honda service, nissan service, bmw service, mercedes service, audi service, volkswagen service,
vw service, mazda service, subaru service, hyundai service, kia service, jeep service, dodge service,
chrysler service, ram service, gmc service, cadillac service, buick service, lincoln service, acura service,
infiniti service, lexus service, volvo service, jaguar service, land rover service, porsche service, mini service,
car maintenance, vehicle maintenance, auto maintenance
"""
OFFICE_SUPPLIES = "office depot, officemax, staples, office supply, stationery, office store"
SPORTS = "dick's sporting, academy sports, bass pro, cabela, rei, sporting goods, outdoor, camping, hunting"
BOOKS = "barnes & noble, books, bookstore, library"
CRAFTS = "michaels, jo-ann, hobby lobby, craft store, fabric, art supply, hobby"
BEAUTY = "ulta, sephora, beauty supply, cosmetic, makeup, hair salon, nail salon, spa"
ENTERTAINMENT = """
movie, cinema, theater, concert, ticketmaster, stubhub, eventbrite, amc, regal, cinemark, netflix, hulu, disney,
streaming, game, video game, steam, playstation, xbox, nintendo
"""
TRANSPORTATION = """
uber, lyft, taxi, metro, subway, bus, train, airline, delta, united, american, southwest, jetblue, parking, toll,
ez pass, car rental, hertz, avis, enterprise
"""
HEALTHCARE = """
pharmacy, cvs, walgreens, rite aid, doctor, hospital, medical, dental, vision, insurance, prescription, clinic,
urgent care, lab, test
"""
EDUCATION = "tuition, school, university, college, course, textbook, student, education, learning, class"
INSURANCE = """
insurance, geico, state farm, allstate, progressive, farmers, liberty mutual, auto insurance, home insurance,
life insurance, health insurance
"""
BANKING = "atm, withdrawal, deposit, transfer, fee, overdraft, interest, bank, credit union"
CHARITY = "donation, charity, nonprofit, red cross, unicef, salvation army, goodwill, contribution, give"
BUSINESS = """
business, office, supplies, equipment, software, saas, service, professional, consulting, freelance
"""
HOME_AND_GARDEN = """
home depot, lowes, homedepot, hardware, garden, furniture, ikea, wayfair, bed bath, home goods
"""
PERSONAL_CARE = "haircut, salon, spa, gym, fitness, yoga, personal care, beauty, cosmetic, pharmacy"
FITNESS = """
planet fitness, 24 hour fitness, 24hr fitness, la fitness, gold's gym, golds gym, ymca, anytime fitness, orangetheory,
crossfit, pure barre, soulcycle, gym, fitness, workout, personal trainer, yoga studio, pilates, spin class
"""
CLOTHING = """
old navy, gap, banana republic, american eagle, aeropostale, h&m, h and m, forever 21, zara, ross, marshalls, tj maxx,
burlington, nike, adidas, under armour, lululemon, clothing, apparel, clothes, fashion, boutique, outlet
"""
MEAL_KITS = "blue apron, hellofresh, hello fresh, instacart, shipt, meal kit, food delivery, grocery delivery"
TRAVEL = """
marriott, hilton, holiday inn, hyatt, sheraton, expedia, booking.com, airbnb, vrbo, hotel, motel, resort, lodging,
travel, vacation, trip
"""
HOME_SERVICES = """
plumber, electrician, hvac, heating, cooling, ac repair, appliance repair, handyman, landscaping, lawn care,
pest control, home repair, contractor, roofing, siding, painting, flooring
"""


def _words(block: str) -> tuple[str, ...]:
    return tuple(" ".join(word.split()) for word in block.split(","))


CATEGORY_RULES: Rules = (
    ("Groceries", _words(GROCERIES)),
    ("Restaurants", _words(RESTAURANTS)),
    ("Gas", _words(GAS)),
    ("Utilities", _words(UTILITIES)),
    ("Subscriptions", _words(SUBSCRIPTIONS)),
    ("Shopping", _words(SHOPPING)),
    ("Pets", _words(PETS)),
    ("Auto Parts", _words(AUTO_PARTS)),
    ("Vehicle Maintenance", _words(VEHICLE_MAINTENANCE)),
    ("Office Supplies", _words(OFFICE_SUPPLIES)),
    ("Sports & Outdoors", _words(SPORTS)),
    ("Books & Media", _words(BOOKS)),
    ("Crafts & Hobbies", _words(CRAFTS)),
    ("Beauty & Personal Care", _words(BEAUTY)),
    ("Entertainment", _words(ENTERTAINMENT)),
    ("Transportation", _words(TRANSPORTATION)),
    ("Healthcare", _words(HEALTHCARE)),
    ("Education", _words(EDUCATION)),
    ("Insurance", _words(INSURANCE)),
    ("Banking", _words(BANKING)),
    ("Charity", _words(CHARITY)),
    ("Business", _words(BUSINESS)),
    ("Home & Garden", _words(HOME_AND_GARDEN)),
    ("Personal Care", _words(PERSONAL_CARE)),
    ("Fitness & Gym", _words(FITNESS)),
    ("Clothing & Apparel", _words(CLOTHING)),
    ("Meal Kits & Delivery", _words(MEAL_KITS)),
    ("Travel & Hotels", _words(TRAVEL)),
    ("Home Services", _words(HOME_SERVICES)),
)


def with_category(rules: Rules, name: str, keywords: list[str]) -> Rules:
    """The rules with one category added last, or its keywords replaced where the name exists."""
    if any(known == name for known, _ in rules):
        return tuple((known, tuple(keywords) if known == name else old) for known, old in rules)
    return (*rules, (name, tuple(keywords)))


def effective(rules: Rules) -> Rules:
    """The rules without keywords that cannot decide anything: one that contains a keyword of the same or an earlier
    category only ever matches where that one already did."""
    kept: list[tuple[str, tuple[str, ...]]] = []
    earlier: list[str] = []
    for name, keywords in rules:
        lowered = [keyword.lower() for keyword in keywords]
        own = [
            k for k in dict.fromkeys(lowered)
            if not any(e in k for e in earlier) and not any(o != k and o in k for o in lowered)
        ]
        kept.append((name, tuple(own)))
        earlier.extend(own)
    return tuple((name, own) for name, own in kept if own)


def category_of(description: str, rules: Rules = CATEGORY_RULES) -> Column:
    """Name of the first category one of whose keywords occurs in the description; NULL where none does.
    `description` is a column name or SQL text."""
    place = {
        keyword.upper(): n for n, (_, keywords) in reversed(list(enumerate(effective(rules), 1))) for keyword in keywords
    }
    best = {word: str(min(place[p] for p in prefixes(word, set(place)))) for word in place}
    names = f"array({', '.join(quote(name) for name, _ in effective(rules))})"
    first = with_words(
        description, place,
        lambda _, found: f"try_element_at({names}, array_min(transform({found}, w -> {lookup('w', best)})))",
    )
    return F.expr(f"CASE WHEN {description} <> '' THEN {first} END")
