"""The bin edges of click and download totals, in full."""

# fmt: off
CLICK_EDGES = (
    6, 24, 42, 60, 78, 96, 114, 132, 150, 168, 186, 204, 222, 240, 258, 276, 294, 312, 330, 348, 366, 384, 402, 420,
    438, 456, 474, 492, 510, 528, 546, 564, 582, 600, 618, 636, 654, 672, 690, 708, 726, 744, 762, 780, 798, 816,
    834, 852, 870, 888, 906, 924, 942, 960, 978, 996, 1014, 1032, 1050, 1068, 1086, 1104, 1122, 1140, 1158, 1176,
    1194, 1212, 1230, 1248, 1266, 1284, 1302, 1320, 1338, 1356, 1374, 1392, 1410, 1428, 1446, 1464, 1482, 1500,
    1518, 1536, 1554, 1572, 1590, 1608, 1626, 1644, 1662, 1680, 1698, 1716, 1734, 1752, 1770, 1788, 1806, 1824,
    1842, 1860, 1878, 1896, 1914, 1932, 1950, 1968, 1986, 2004, 2022, 2040, 2058, 2076, 2094, 2112, 2130, 2148,
    2166, 2184, 2202, 2220, 2238, 2256, 2274, 2292, 2310, 2328, 2346, 2364, 2382, 2400, 2418, 2436, 2454, 2472,
    2490, 2508, 2526, 2544, 2562, 2580, 2598, 2616, 2634, 2652, 2670, 2688, 2706, 2724, 2742, 2760, 2778, 2796,
    2814, 2832, 2850, 2868, 2886, 2904, 2922, 2940, 2958, 2976, 2994, 3012, 3030, 3048, 3066, 3084, 3102, 3120,
    3138, 3156, 3174, 3192, 3210, 3228, 3246, 3264, 3282, 3300, 3318, 3336, 3354, 3372, 3390, 3408, 3426, 3444,
    3462, 3480, 3498, 3516, 3534, 3552, 3570, 3588, 3606, 3624, 3642, 3660, 3678, 3696, 3714, 3732, 3750, 3768,
    3786, 3804, 3822, 3840, 3858, 3876, 3894, 3912, 3930, 3948, 3966, 3984, 4002, 4020, 4038, 4056, 4074, 4092,
    4110, 4128, 4146, 4164, 4182, 4200, 4218, 4236, 4254, 4272, 4290, 4308, 4326, 4344, 4362, 4380, 4398, 4416,
    4434, 4452, 4470, 4488, 4506, 4524, 4542, 4560, 4578, 4596, 4614, 4632, 4650, 4668, 4686, 4704, 4722, 4740,
    4759, 4777, 4795, 4814, 4832, 4850, 4868, 4886, 4904, 4922, 4940, 4958, 4976, 4996, 5014, 5032, 5050, 5068,
    5086, 5104, 5122, 5140, 5158, 5177, 5195, 5213, 5231, 5249, 5267, 5285, 5303, 5321, 5340, 5358, 5376, 5394,
    5412, 5430, 5448, 5466, 5484, 5502, 5520, 5538, 5556, 5575, 5593, 5611, 5629, 5648, 5666, 5684, 5702, 5720,
    5739, 5757, 5775, 5793, 5812, 5830, 5849, 5869, 5887, 5907, 5927, 5945, 5963, 5982, 6002, 6020, 6038, 6057,
    6077, 6096, 6114, 6133, 6151, 6170, 6188, 6206, 6224, 6242, 6260, 6279, 6299, 6320, 6338, 6358, 6376, 6394,
    6413, 6435, 6454, 6474, 6492, 6511, 6530, 6550, 6569, 6589, 6608, 6627, 6648, 6669, 6688, 6710, 6730, 6748,
    6768, 6791, 6809, 6827, 6849, 6868, 6886, 6905, 6924, 6942, 6963, 6982, 7003, 7024, 7044, 7066, 7089, 7110,
    7129, 7147, 7168, 7190, 7212, 7233, 7251, 7269, 7288, 7308, 7329, 7349, 7367, 7390, 7409, 7430, 7449, 7468,
    7491, 7514, 7534, 7554, 7574, 7594, 7616, 7637, 7657, 7679, 7698, 7719, 7743, 7764, 7784, 7805, 7826, 7848,
    7869, 7888, 7909, 7930, 7951, 7970, 7989, 8010, 8030, 8052, 8073, 8093, 8115, 8137, 8157, 8179, 8201, 8219,
    8239, 8258, 8278, 8300, 8321, 8341, 8361, 8384, 8402, 8421, 8442, 8462, 8481, 8502, 8523, 8542, 8562, 8581,
    8599, 8624, 8646, 8667, 8686, 8709, 8732, 8755, 8776, 8796, 8821, 8842, 8863, 8882, 8905, 8924, 8948, 8967,
    8987, 9006, 9027, 9047, 9070, 9095, 9119, 9142, 9163, 9184, 9204, 9224, 9246, 9266, 9287, 9307, 9329, 9348,
    9367, 9387, 9411, 9432, 9453, 9477, 9500, 9521, 9548, 9570, 9593, 9616, 9638, 9660, 9684, 9703, 9722, 9752,
    9775, 9797, 9824, 9846, 9866, 9891, 9912, 9942, 9963, 9984, 10006, 10027, 10051, 10076, 10100, 10122, 10144,
    10165, 10194, 10217, 10240, 10263, 10289, 10308, 10328, 10353, 10374, 10404, 10423, 10448, 10475, 10498, 10517,
    10543, 10569, 10593, 10624, 10653, 10682, 10704, 10736, 10766, 10790, 10818, 10838, 10864, 10891, 10910, 10933,
    10958, 10988, 11015, 11041, 11066, 11090, 11112, 11141, 11168, 11189, 11215, 11242, 11264, 11294, 11327, 11354,
    11384, 11404, 11434, 11465, 11495, 11521, 11553, 11579, 11612, 11636, 11666, 11701, 11742, 11770, 11808, 11833,
    11872, 11900, 11931, 11970, 12008, 12043, 12082, 12113, 12144, 12175, 12208, 12242, 12282, 12326, 12357, 12393,
    12428, 12464, 12500, 12539, 12578, 12616, 12656, 12692, 12737, 12769, 12798, 12823, 12856, 12892, 12929, 12968,
    12997, 13030, 13062, 13095, 13136, 13164, 13192, 13223, 13250, 13282, 13311, 13344, 13381, 13413, 13448, 13480,
    13509, 13548, 13595, 13630, 13667, 13702, 13740, 13769, 13800, 13831, 13858, 13896, 13928, 13961, 13996, 14027,
    14059, 14086, 14115, 14147, 14172, 14209, 14244, 14272, 14303, 14339, 14368, 14409, 14444, 14481, 14512, 14537,
    14569, 14603, 14641, 14683, 14723, 14754, 14796, 14833, 14882, 14911, 14940, 14977, 15017, 15053, 15096, 15127,
    15162, 15197, 15229, 15267, 15304, 15339, 15377, 15409, 15436, 15468, 15500, 15527, 15558, 15591, 15627, 15659,
    15699, 15731, 15761, 15787, 15814, 15846, 15878, 15908, 15941, 15962, 15993, 16028, 16061, 16089, 16129, 16161,
    16188, 16217, 16245, 16276, 16313, 16345, 16386, 16417, 16452, 16485, 16517, 16549, 16582, 16613, 16642, 16679,
    16722, 16754, 16800, 16838, 16870, 16916, 16961, 17016, 17074, 17134, 17190, 17245, 17296, 17349, 17398, 17442,
    17492, 17557, 17621, 17678, 17729, 17808, 17878, 17933, 17997, 18064, 18109, 18158, 18206, 18287, 18336, 18382,
    18448, 18526, 18589, 18660, 18722, 18770, 18820, 18880, 18958, 19015, 19078, 19153, 19210, 19272, 19324, 19392,
    19475, 19552, 19628, 19698, 19763, 19829, 19894, 19959, 20065, 20134, 20186, 20277, 20366, 20454, 20517, 20605,
    20682, 20776, 20874, 20953, 21037, 21127, 21262, 21351, 21486, 21598, 21721, 21840, 21962, 22055, 22170, 22309,
    22425, 22512, 22630, 22767, 22905, 23054, 23181, 23370, 23476, 23631, 23788, 23924, 24034, 24208, 24436, 24640,
    24734, 24899, 25031, 25137, 25250, 25404, 25603, 25719, 25920, 26073, 26202, 26437, 26652, 26846, 27088, 27311,
    27515, 27694, 27932, 28098, 28268, 28503, 28733, 28888, 29189, 29427, 29656, 29842, 30105, 30356, 30623, 30899,
    31208, 31403, 31549, 31746, 32002, 32248, 32490, 32669, 32860, 33117, 33393, 33729, 33911, 34263, 34557, 34792,
    35068, 35366, 35659, 36184, 36572, 36984, 37336, 37655, 37968, 38221, 38472, 38792, 39025, 39257, 39437, 39684,
    40146, 40614, 40986, 41576, 41932, 42470, 43068, 43604, 44059, 44499, 44918, 45672, 46224, 47013, 47703, 48271,
    48824, 49453, 50078, 50799, 51762, 52616, 53910, 54826, 55750, 56437, 57174, 58026, 58821, 59813, 60947, 62279,
    63174, 64316, 65280, 67675, 68888, 70022, 71085, 73140, 74870, 76119, 77466, 79297, 80770, 82436, 83639, 85976,
    88463, 90027, 91684, 94896, 98646, 101433, 104473, 106440, 110172, 113455, 115631, 118694, 123290, 126315,
    129578, 133876, 138042, 142207, 145147, 149323, 153903, 158916, 162550, 168480, 171246, 176873, 185885, 194406,
    206512, 213394, 223038, 232279, 243204, 256882, 268047, 282804, 299103, 317156, 327672, 343250, 359524, 374181,
    399984, 431865, 459066, 482786, 514375, 552909, 587097, 643008, 679861, 716411, 767949, 809723, 865592, 935200,
    1020121, 1156169, 1249827, 1333734, 1479377, 1736408, 1935777, 2448710, 2711240, 3268868, 3873319, 4692438,
    5796274, 10027169, 44181914,
)

DOWNLOAD_EDGES = (
    0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60, 64, 68, 72, 76, 80, 84, 88, 92, 96, 100, 104, 108,
    112, 116, 120, 124, 128, 132, 136, 140, 144, 148, 152, 156, 160, 164, 168, 172, 176, 180, 184, 188, 192, 197,
    201, 205, 209, 213, 218, 223, 227, 231, 235, 239, 244, 248, 254, 258, 263, 268, 272, 276, 284, 291, 296, 304,
    308, 315, 320, 327, 332, 339, 343, 349, 355, 360, 365, 372, 377, 381, 385, 389, 395, 401, 407, 412, 420, 430,
    437, 449, 454, 465, 472, 483, 487, 492, 504, 508, 517, 525, 534, 542, 548, 553, 562, 570, 576, 582, 590, 601,
    610, 615, 621, 628, 644, 652, 664, 678, 682, 689, 700, 708, 716, 727, 739, 749, 754, 764, 771, 779, 809, 823,
    842, 852, 868, 881, 895, 903, 928, 959, 995, 1010, 1026, 1041, 1059, 1080, 1105, 1128, 1149, 1173, 1200, 1230,
    1255, 1294, 1324, 1349, 1383, 1418, 1459, 1471, 1504, 1537, 1577, 1613, 1661, 1752, 1812, 1834, 1859, 1909,
    1985, 2035, 2048, 2094, 2172, 2214, 2224, 2261, 2285, 2314, 2348, 2353, 2401, 2454, 2544, 2606, 2640, 2726,
    2830, 2926, 2978, 3247, 3503, 3668, 3869, 4125, 4262, 4546, 4956, 5065, 5289, 5486, 5560, 5661, 5707, 5891,
    6065, 6264, 6675, 6943, 7156, 8198, 9477, 10272, 11061, 11615, 12687, 13115, 16321, 18740, 19534, 25885, 27263,
    33176, 38039, 42469, 61049, 79162, 101817,
)
