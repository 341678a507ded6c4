"""Pages about one vehicle."""

from pyspark.sql import functions as F

from loomwright.sources import vehicle_pages


def test_vehicles(spark):
    rows = [
        (1, "http://a.com/vehicle/12?x", "<h1>2019 jeep Wrangler</h1>"), (2, "http://a.com/inventory/used/x", "<p>nothing</p>"), (3, "http://a.com/", "<title>2020 Kia — Shop</title><dl><dt>Stock #:</dt><dd>K 7</dd><dt>Seating</dt><dd>5 places</dd><dt>Towing</dt><dd>900 kg</dd><dt>Transmission</dt></dl>"),
        (4, "http://a.com/", "<h1>Fuel for thought: new models</h1><p>Engine: V8</p>"), (5, None, None), (6, None, ""), (7, None, '<div data-stock="S1" data-vin="short">MSRP: call us</div>Price: 1,200.50 today<br>Highway: 9.5 / City: none'),
    ]
    got = {r.id: r for r in vehicle_pages.vehicles(spark.createDataFrame(rows, "id int, url string, html string"), "id", "url", "html").collect()}
    assert sorted(got) == [1, 3, 7]
    assert (got[1].title, got[1].year, got[1].make, got[1].condition, got[1].vin, got[1].images) == ("2019 jeep Wrangler", 2019, "Jeep", "used", None, [])
    assert (got[3].title, got[3].make, got[3].stock_number, got[3].interior_color, got[3].passengers, got[3].towing_capacity, got[3].transmission, got[3].fuel_unit) == ("2020 Kia", "Kia", "K 7", "5 places", 5, "900 kg", None, "MPG")
    assert (got[7].title, got[7].stock_number, got[7].vin, got[7].msrp, got[7].highway_fuel, got[7].city_fuel, got[7].price) == ("", "S1", None, None, 9.5, None, 1200.5)


def test_urls(spark):
    urls = ["http://a/used/2020-ford-id12.html", "http://a/used/id12.html", "http://a/INVENTORY/new/x", "http://a/inventory/new/", "http://a/vehicle/9", "http://a/vehicle/x9", "", None]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    assert [r.x for r in df.orderBy("i").select(vehicle_pages.is_vehicle_url(F.col("u")).alias("x")).collect()] == [True, False, True, False, True, False, False, False]
