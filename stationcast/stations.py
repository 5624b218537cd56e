"""The default station list. Another list is read with ``sources.dimensions.read_stations``."""

# Name, slug, latitude, longitude, IANA time zone.
STATIONS_CSV = """\
Tokyo,tokyo,35.6762,139.6503,Asia/Tokyo
Delhi,delhi,28.6139,77.2090,Asia/Kolkata
Shanghai,shanghai,31.2304,121.4737,Asia/Shanghai
Sao Paulo,sao-paulo,-23.5505,-46.6333,America/Sao_Paulo
Mexico City,mexico-city,19.4326,-99.1332,America/Mexico_City
Cairo,cairo,30.0444,31.2357,Africa/Cairo
Mumbai,mumbai,19.0760,72.8777,Asia/Kolkata
Beijing,beijing,39.9042,116.4074,Asia/Shanghai
Dhaka,dhaka,23.8103,90.4125,Asia/Dhaka
Osaka,osaka,34.6937,135.5023,Asia/Tokyo
New York,new-york,40.7128,-74.0060,America/New_York
Karachi,karachi,24.8607,67.0011,Asia/Karachi
Buenos Aires,buenos-aires,-34.6037,-58.3816,America/Argentina/Buenos_Aires
Chongqing,chongqing,29.4316,106.9123,Asia/Shanghai
Istanbul,istanbul,41.0082,28.9784,Europe/Istanbul
Kolkata,kolkata,22.5726,88.3639,Asia/Kolkata
Manila,manila,14.5995,120.9842,Asia/Manila
Lagos,lagos,6.5244,3.3792,Africa/Lagos
Rio de Janeiro,rio-de-janeiro,-22.9068,-43.1729,America/Sao_Paulo
Tianjin,tianjin,39.3434,117.3616,Asia/Shanghai
Kinshasa,kinshasa,-4.4419,15.2663,Africa/Kinshasa
Guangzhou,guangzhou,23.1291,113.2644,Asia/Shanghai
Los Angeles,los-angeles,34.0522,-118.2437,America/Los_Angeles
Moscow,moscow,55.7558,37.6173,Europe/Moscow
Shenzhen,shenzhen,22.5431,114.0579,Asia/Shanghai
Lahore,lahore,31.5204,74.3587,Asia/Karachi
Bangalore,bangalore,12.9716,77.5946,Asia/Kolkata
Paris,paris,48.8566,2.3522,Europe/Paris
Bogota,bogota,4.7110,-74.0721,America/Bogota
Jakarta,jakarta,-6.2088,106.8456,Asia/Jakarta
Chennai,chennai,13.0827,80.2707,Asia/Kolkata
Lima,lima,-12.0464,-77.0428,America/Lima
Bangkok,bangkok,13.7563,100.5018,Asia/Bangkok
Seoul,seoul,37.5665,126.9780,Asia/Seoul
Nagoya,nagoya,35.1815,136.9066,Asia/Tokyo
Hyderabad,hyderabad,17.3850,78.4867,Asia/Kolkata
London,london,51.5074,-0.1278,Europe/London
Tehran,tehran,35.6892,51.3890,Asia/Tehran
Chicago,chicago,41.8781,-87.6298,America/Chicago
Chengdu,chengdu,30.5728,104.0668,Asia/Shanghai
Nanjing,nanjing,32.0603,118.7969,Asia/Shanghai
Wuhan,wuhan,30.5928,114.3055,Asia/Shanghai
Ho Chi Minh City,ho-chi-minh-city,10.8231,106.6297,Asia/Ho_Chi_Minh
Luanda,luanda,-8.8390,13.2894,Africa/Luanda
Ahmedabad,ahmedabad,23.0225,72.5714,Asia/Kolkata
Kuala Lumpur,kuala-lumpur,3.1390,101.6869,Asia/Kuala_Lumpur
Xian,xian,34.3416,108.9398,Asia/Shanghai
Hong Kong,hong-kong,22.3193,114.1694,Asia/Hong_Kong
Dongguan,dongguan,23.0207,113.7519,Asia/Shanghai
Hangzhou,hangzhou,30.2741,120.1551,Asia/Shanghai
Foshan,foshan,23.0219,113.1215,Asia/Shanghai
Shenyang,shenyang,41.8057,123.4315,Asia/Shanghai
Riyadh,riyadh,24.7136,46.6753,Asia/Riyadh
Baghdad,baghdad,33.3152,44.3661,Asia/Baghdad
Santiago,santiago,-33.4489,-70.6693,America/Santiago
Surat,surat,21.1702,72.8311,Asia/Kolkata
Madrid,madrid,40.4168,-3.7038,Europe/Madrid
Suzhou,suzhou,31.2989,120.5853,Asia/Shanghai
Pune,pune,18.5204,73.8567,Asia/Kolkata
Harbin,harbin,45.8038,126.5350,Asia/Shanghai
Houston,houston,29.7604,-95.3698,America/Chicago
Dallas,dallas,32.7767,-96.7970,America/Chicago
Toronto,toronto,43.6532,-79.3832,America/Toronto
Dar es Salaam,dar-es-salaam,-6.7924,39.2083,Africa/Dar_es_Salaam
Miami,miami,25.7617,-80.1918,America/New_York
Belo Horizonte,belo-horizonte,-19.9167,-43.9345,America/Sao_Paulo
Singapore,singapore,1.3521,103.8198,Asia/Singapore
Philadelphia,philadelphia,39.9526,-75.1652,America/New_York
Atlanta,atlanta,33.7490,-84.3880,America/New_York
Fukuoka,fukuoka,33.5902,130.4017,Asia/Tokyo
Khartoum,khartoum,15.5007,32.5599,Africa/Khartoum
Barcelona,barcelona,41.3851,2.1734,Europe/Madrid
Johannesburg,johannesburg,-26.2041,28.0473,Africa/Johannesburg
Saint Petersburg,saint-petersburg,59.9311,30.3609,Europe/Moscow
Qingdao,qingdao,36.0671,120.3826,Asia/Shanghai
Jeddah,jeddah,21.4858,39.1925,Asia/Riyadh
Abidjan,abidjan,5.3600,-4.0083,Africa/Abidjan
Zhengzhou,zhengzhou,34.7466,113.6253,Asia/Shanghai
Nairobi,nairobi,-1.2921,36.8219,Africa/Nairobi
Alexandria,alexandria,31.2001,29.9187,Africa/Cairo
Casablanca,casablanca,33.5731,-7.5898,Africa/Casablanca
Kabul,kabul,34.5553,69.2075,Asia/Kabul
Accra,accra,5.6037,-0.1870,Africa/Accra
Cape Town,cape-town,-33.9249,18.4241,Africa/Johannesburg
Sydney,sydney,-33.8688,151.2093,Australia/Sydney
Melbourne,melbourne,-37.8136,144.9631,Australia/Melbourne
Rome,rome,41.9028,12.4964,Europe/Rome
Berlin,berlin,52.5200,13.4050,Europe/Berlin
Addis Ababa,addis-ababa,9.0320,38.7469,Africa/Addis_Ababa
Yangon,yangon,16.8661,96.1951,Asia/Rangoon
Kathmandu,kathmandu,27.7172,85.3240,Asia/Kathmandu
Ankara,ankara,39.9334,32.8597,Europe/Istanbul
Athens,athens,37.9838,23.7275,Europe/Athens
Taipei,taipei,25.0330,121.5654,Asia/Taipei
Amsterdam,amsterdam,52.3676,4.9041,Europe/Amsterdam
Dubai,dubai,25.2048,55.2708,Asia/Dubai
Caracas,caracas,10.4806,-66.9036,America/Caracas
Guadalajara,guadalajara,20.6597,-103.3496,America/Mexico_City
Monterrey,monterrey,25.6866,-100.3161,America/Monterrey
"""
