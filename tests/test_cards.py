"""Cards of pages."""

from loomwright.sources import cards


def test_cards(spark):
    html = """<div class="vehicle-card" data-vin="1hgcm82633a004352"><h3>Civic  LX</h3><span>12,500 miles, Certified</span></div>
    <div class="item"><h2>Short</h2></div><div class="item"><h2>""" + "x" * 121 + """</h2><p>a title that is too long for a card</p></div><div class="item"><h2>Long one</h2><p>""" + "y" * 8000 + """</p></div>
    <div class="plain"><h2>No card by its name</h2><p>but all that a card has beside</p></div><li class="gig-box"><a class="title" href="https://a.b/other?x=1">Gig &lt;1&gt;</a><span>from 30 EUR today</span>"""
    deep = "<div class='card'>" * 3000 + "<h2>Deep</h2><p>description of it</p>"
    rows = [(1, "https://a.b/c", html), (2, "u", None), (3, None, ""), (4, "https://a.b/inventory", "<article id='item-9'><h4>Thing here</h4><img src='placeholder.png'><a href='/t'>see it</a></article>"), (5, "https://a.b/", deep)]
    got = {(r.id, r.title): r for r in cards.cards(spark.createDataFrame(rows, "id int, url string, html string"), "id", "url", "html").collect()}
    assert sorted(got) == [(1, "Civic LX"), (1, "Gig <1>"), (4, "Thing here"), (5, "Deep")]
    car, gig, thing = got[1, "Civic LX"], got[1, "Gig <1>"], got[4, "Thing here"]
    assert (car.vin, car.mileage, car.condition, car.data_type, car.price, car.url) == ("1HGCM82633A004352", 12500, "cpo", "product", None, "https://a.b/c")
    assert (gig.price, gig.url, gig.condition, gig.data_type) == ("30 EUR", "https://a.b/other?x=1", None, "product")
    assert (thing.url, thing.image, thing.data_type, thing.condition) == ("https://a.b/t", None, "product", "used")
