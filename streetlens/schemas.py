"""Fixed schemas of the collections; every reader uses them, nothing is inferred."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField,
    StructType, TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _D, _T, _B = StringType(), IntegerType(), DoubleType(), TimestampType(), BooleanType()
_STRINGS = ArrayType(_S)

BUSINESSES = _struct(
    source_id=_S, source=_S, name=_S, address=_S, city=_S, state=_S, category=_S,
    subcategory=_STRINGS, rating=_D, review_count=_I, price_level=_I, phone=_S, website=_S,
    hours=MapType(_S, _S), latitude=_D, longitude=_D, description=_S, images=_STRINGS,
    amenities=_STRINGS, place_id=_S, reviews_fetched=_B, last_updated=_T,
)

REVIEWS = _struct(
    source_review_id=_S, source=_S, business_id=_S, business_name=_S, business_city=_S,
    business_category=_S, reviewer_name=_S, reviewer_id=_S, rating=_I, review_text=_S,
    review_date=_T, helpful_votes=_I, sentiment_score=_D, sentiment_label=_S,
    sentiment_confidence=_D, sentiment_method=_S, keywords=_STRINGS, phrases=_STRINGS,
    processed_at=_T, last_updated=_T,
)

EVENTS = _struct(
    source_id=_S, source=_S, name=_S, description=_S, venue=_S, venue_address=_S, date=_T, time=_S,
    price=_S, category=_S, organizer=_S, latitude=_D, longitude=_D, last_updated=_T,
)

TRENDING_KEYWORDS = _struct(
    text=_S, weight=_D, count=LongType(), generated_at=_T, period_days=_I,
)

RATING_ANOMALIES = _struct(
    business_id=_S, business_name=_S,
    anomalies=ArrayType(_struct(
        month=_S, rating_change=_D, previous_rating=_D, current_rating=_D, type=_S, severity=_S,
    )),
    detected_at=_T,
)

_POINT = _struct(latitude=_D, longitude=_D)
_TEXT = _struct(text=_S, languageCode=_S)
_AUTHOR = _struct(displayName=_S, uri=_S, photoUri=_S)

PLACE = _struct(
    id=_S, displayName=_struct(text=_S), formattedAddress=_S, rating=_D, userRatingCount=_I,
    location=_POINT, types=_STRINGS, nationalPhoneNumber=_S, priceLevel=_S,
)
PLACES_RESPONSE = _struct(places=ArrayType(PLACE))

LEGACY_PLACE = _struct(
    place_id=_S, name=_S, vicinity=_S, rating=_D, user_ratings_total=_I, types=_STRINGS,
    price_level=_I, geometry=_struct(location=_struct(lat=_D, lng=_D)),
)
LEGACY_RESPONSE = _struct(status=_S, results=ArrayType(LEGACY_PLACE))

PLACE_REVIEW = _struct(
    authorAttribution=_AUTHOR, text=_TEXT, originalText=_TEXT, publishTime=_S,
    relativePublishTimeDescription=_S, rating=_I,
)
_HOUR = _struct(day=_I, time=_S)
PLACE_DETAILS = _struct(
    displayName=_struct(text=_S), formattedAddress=_S, rating=_D, userRatingCount=_I,
    location=_POINT, types=_STRINGS, nationalPhoneNumber=_S, priceLevel=_S, websiteUri=_S,
    regularOpeningHours=_struct(periods=ArrayType(_struct(open=_HOUR, close=_HOUR))),
    reviews=ArrayType(PLACE_REVIEW),
)
