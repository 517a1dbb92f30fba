"""Published yearly and monthly record counts and the figures made from them."""

FIRST_YEAR = 1953
YEARLY = [
    13, 17, 18, 16, 16, 7, 7, 12, 12, 22, 20, 136, 429, 120, 196, 161, 505, 223, 174, 526, 872,
    621, 461, 591, 1165, 442, 474, 202, 55, 158, 205, 268, 336, 286, 169, 56, 463, 615, 625, 385,
    1712, 696, 607, 1695, 922, 1549, 1423, 1082, 1148, 1040, 1574, 1853, 4736, 975, 1640, 2300,
    1265, 1635, 2690, 1292, 771, 689, 963, 1194, 1668, 1184, 1666, 9712, 1962, 1141, 1119, 2364,
    1203, 1382,
]
MONTHLY = [6111, 4955, 11140, 7128, 5240, 4931, 5101, 5849, 11721, 4007, 1674, 2074]
SEASONS = {"Spring": 23508, "Fall": 17402, "Summer": 15881, "Winter": 13140}
SPIKES = [(2020, 9712), (2005, 4736), (2011, 2690)]
TREND = ("increasing", 1422.0, 2321.3, 63.2)
TOTAL = 69931
